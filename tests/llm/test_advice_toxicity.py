"""Labels teach insults, but leave the other classes of the grammar as they are."""

from __future__ import annotations

from hushframe.llm import toxicity
from hushframe.llm import transducers as T


def test_fixed_classes_stay_and_all_words_are_learned(spark):
    said = [f"you never kill idiot blarg word{i // 6}x word{i // 6}y" for i in range(600)]
    rows = [(2 * i, t) for i, t in enumerate(said)] + [(2 * i + 1, f"fine weather {i}") for i in range(600)]
    many = " ".join(f"rare{i}" for i in range(5000))
    rows += [(5000 + i, f"{many} {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 5000 or i % 2 == 0)) for i, _ in rows], "doc_id long, toxic int")
    words = toxicity.learn_toxicity(docs, labels).grammar.words
    fixed = toxicity._classes()
    assert all(words[w] == fixed[w] for w in ("you", "never", "kill"))
    assert words["blarg"][0] == words["idiot"][0] == T.INSULT and words["idiot"] != fixed["idiot"]
    assert all(words[f"rare{i}"][0] == T.INSULT for i in range(5000))
