"""SQL text for keyed uniforms and noise, as the checking engine spells them."""

from __future__ import annotations

from hushframe.functions.noise import SeededNoise

SEED = "42"
NOISE = SeededNoise(SEED, "md5")


def d(x: float) -> str:
    """A double literal."""
    return f"'{float(x)!r}'::double"


def h52(seed: str | int, *parts: str) -> str:
    return f"cast('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(parts)})), 1, 13) as bigint)"


def u(label: str, stream: int = 1, *keys: str, seed: str = SEED) -> str:
    text = h52(seed, f"'{label}'", f"'{stream}'", *keys)
    return f"((cast({text} as double) + {d(0.5)}) / {d(4503599627370496.0)})"


def plain_uniform(seed: str, *parts: str) -> str:
    return f"((cast({h52(seed, *parts)} as double) + {d(0.5)}) / {d(4503599627370496.0)})"


def laplace(label: str, scale: str, *keys: str) -> str:
    x = f"({u(label, 1, *keys)} - {d(0.5)})"
    return f"(-({scale}) * sign({x}) * ln({d(1)} - {d(2)} * abs({x})))"


def geometric(label: str, scale: str, *keys: str) -> str:
    def one(stream: int) -> str:
        return f"cast(floor(ln({u(label, stream, *keys)}) / ({d(-1)} / ({scale}))) as bigint)"

    return f"({one(1)} - {one(2)})"


def gaussian(label: str, sigma_sq: str, *keys: str) -> str:
    radius = f"sqrt({d(-2)} * ln({u(label, 1, *keys)}))"
    return f"(sqrt({sigma_sq}) * {radius} * cos({d(6.283185307179586)} * {u(label, 2, *keys)}))"


def clamp(c: str, low: float, high: float) -> str:
    inside = f"greatest(least(cast({c} as double), {d(high)}), {d(low)})"
    return f"(case when {c} is not null and not isnan(cast({c} as double)) then {inside} end)"
