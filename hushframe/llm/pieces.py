"""SentencePiece encoding that keeps every piece's place in the original text, and decoding.

A text is normalised by longest-prefix replacement through the model's compiled character map; the
normaliser records which original byte each normalised byte comes from. The library encodes, the
pieces are laid along the normalised bytes, and the record projects their ends to the original.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import importable
from hushframe.llm.packing import slices

#: What the library writes for a space.
MARK = "▁".encode()


class CharacterMap:
    """The model's replacements: a double-array trie and the strings that its values point into.

    The blob is the trie's size in bytes, the trie as 32-bit units, and zero-ended replacements. A
    unit's label is in its low 8 bits (with bit 31), bit 8 says that a value follows, and the offset is
    in the bits from 10, scaled by 256 if bit 9 is set.
    """

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist() if blob else []
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes that the longest entry starting here covers, and its replacement."""
        units = self.units
        if not units:
            return None
        node, found = self._offset(units[0]), None
        for length in range(1, len(data) - at + 1):
            byte = data[at + length - 1]
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = length, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        begin = found[1]
        return found[0], self.strings[begin : self.strings.index(b"\0", begin)]

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)


class PieceCoder:
    """Encoding with spans and decoding for one model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        spec = model.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.escape = spec.escape_whitespaces
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        byte = sentencepiece_model_pb2.ModelProto.SentencePiece.BYTE
        control = sentencepiece_model_pb2.ModelProto.SentencePiece.CONTROL
        sizes = [1 if p.type == byte else 0 if p.type == control else len(p.piece.encode()) for p in model.pieces]
        self.sizes = np.array(sizes, np.int64)
        self.unknown = self.library.unk_id()

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and where each and the end of all come from in the original's bytes."""
        data = text.encode()
        mark = MARK if self.escape else b" "
        if not self.map.units and not self.squeeze and not self.suffix:
            return self._plain(data, mark)
        return self._mapped(data, mark)

    def _plain(self, data: bytes, mark: bytes) -> tuple[bytes, np.ndarray]:
        """No map: only spaces change, all at once."""
        if not data:
            return b"", np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)
        counts = np.where(raw == 32, len(mark), 1)
        origin = np.repeat(np.arange(len(raw)), counts)
        lead = len(mark) if self.prefix else 0
        origin = np.concatenate([np.zeros(lead, np.int64), origin, [len(raw)]])
        return mark * bool(lead) + data.replace(b" ", mark), origin

    def _mapped(self, data: bytes, mark: bytes) -> tuple[bytes, np.ndarray]:
        chunks: list[tuple[bytes, int, int]] = []
        at = 0
        while at < len(data):
            found = self.map.longest(data, at)
            if found is None:
                size = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                found = size, data[at : at + size]
            chunks.append((found[1], at, at + found[0]))
            at += found[0]
        if self.squeeze:
            while chunks and chunks[0][0] == b" ":
                chunks.pop(0)
        if not chunks:
            return b"", np.zeros(1, np.int64)
        out, origin = bytearray(), []

        def write(piece: bytes, start: int) -> None:
            out.extend(piece)
            origin.extend([start] * len(piece))

        if self.prefix and not self.suffix:
            write(mark, chunks[0][1])
        space = self.squeeze
        for piece, start, _ in chunks:
            if self.squeeze and space:
                piece = piece.lstrip(b" ")
            if piece:
                for part in piece:
                    write(mark if part == 32 else bytes([part]), start)
                space = piece.endswith(b" ")
            if not self.squeeze:
                space = False
        end = chunks[-1][2]
        if self.squeeze:
            while out.endswith(mark):
                del out[-len(mark) :]
                end = origin[len(out)]
                del origin[len(out) :]
        if self.prefix and self.suffix:
            write(mark, end)
        return bytes(out), np.array([*origin, end], np.int64)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end byte in the original of each id; control ids are empty, at the end of the text."""
        normal, origin = self.normalise(text)
        sizes = self.sizes[ids]
        if (ids == self.unknown).any():
            sizes = self._with_unknown(normal, ids, sizes)
        ends = np.cumsum(sizes)
        if len(ids) and ends[-1] != len(normal):
            raise ValueError("pieces do not cover the normalised text")
        return origin[ends - sizes], origin[ends]

    def _with_unknown(self, normal: bytes, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """An unknown id covers what lies before the next known piece."""
        sizes, at = sizes.copy(), 0
        for i, one in enumerate(ids):
            if one == self.unknown:
                known = next((self.library.id_to_piece(int(x)).encode() for x in ids[i + 1 :] if x != self.unknown and self.sizes[x]), None)
                stop = normal.find(known, at + 1) if known else len(normal)
                sizes[i] = stop - at
            at += int(sizes[i])
        return sizes


_CODERS: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    """One per worker and model."""
    if path not in _CODERS:
        _CODERS[path] = PieceCoder(path)
    return _CODERS[path]


def encode_pieces(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end: bool = True
) -> DataFrame:
    """doc_id, ids, starts, ends (bytes of the original UTF-8 text) and decoded of each row.

    Ids are the library's, without sampling and, if `end`, with an end id, whose span is empty. Null
    is encoded like an empty text. Repeated rows each for itself; other columns are not read.
    """
    importable(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    names = ["id", "ids", "starts", "ends", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = coder(path)
        for whole in batches:
            for low, high in slices(whole.column(1), 1 << 21):
                batch = whole.slice(low, high - low)
                texts = batch.column(1).to_pylist()
                ids = use.library.encode(texts, add_eos=end, num_threads=1)
                decoded = use.library.decode(ids)
                arrays = [np.array(one, np.int32) for one in ids]
                spans = [use.spans(t, one) for t, one in zip(texts, arrays)]
                offsets = pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32())

                def lists(parts: list[np.ndarray]) -> pa.Array:
                    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts).astype(np.int32)))

                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), lists(arrays), lists([a for a, _ in spans]), lists([b for _, b in spans]),
                     pa.array(decoded, pa.string())], names,
                )

    schema = f"id {kind}, ids array<int>, starts array<int>, ends array<int>, decoded string"
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", doc_id)
