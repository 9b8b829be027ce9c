"""Normal density, distribution and error function as SQL expressions; Spark has no erf.

The expressions are text, so that the same formula can be checked by another engine. The argument should be a column
name, as it is repeated.
"""

from __future__ import annotations

from statistics import NormalDist

#: Rational Chebyshev approximations of erf by W. J. Cody (1969), near 0, to 4, and beyond.
NEAR = ([3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1], [2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03])
MIDDLE = (
    [5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8],
    [1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03],
)
FAR = ([3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2], [2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3])
INV_SQRT_PI = 0.5641895835477563
INV_SQRT_2PI = 0.3989422804014327
SQRT_2 = 1.4142135623730951


def number(x: float) -> str:
    """A literal that both engines read as a double."""
    return f"CAST({x!r} AS DOUBLE)"


def _ratio(y: str, coefficients: tuple[list[float], list[float]]) -> str:
    top, bottom = coefficients
    num, den = f"{number(top[-1])} * {y}", y
    for a, b in zip(top[:-2], bottom[:-1]):
        num, den = f"({num} + {number(a)}) * {y}", f"({den} + {number(b)}) * {y}"
    return f"(({num} + {number(top[-2])}) / ({den} + {number(bottom[-1])}))"


def erf(x: str) -> str:
    """Error function of a finite x; null for null."""
    size, square, inverse = f"abs({x})", f"({x} * {x})", f"(1 / ({x} * {x}))"
    middle = f"exp(-{square}) * {_ratio(size, MIDDLE)}"
    far = f"exp(-{square}) * (({number(INV_SQRT_PI)} - {inverse} * {_ratio(inverse, FAR)}) / {size})"
    return f"CASE WHEN {size} <= 0.46875 THEN {x} * {_ratio(square, NEAR)} WHEN {size} <= 4 THEN sign({x}) * (1 - {middle}) WHEN {size} < 27 THEN sign({x}) * (1 - {far}) ELSE CAST(sign({x}) AS DOUBLE) END"


def pdf(z: str) -> str:
    return f"({number(INV_SQRT_2PI)} * exp(-({z} * {z}) / 2))"


def half_width(level: float) -> float:
    """Half width, in standard deviations, of the central interval that holds so much of a normal distribution."""
    if not 0 < level < 1:
        raise ValueError(f"the level must be in (0, 1): {level}")
    return NormalDist().inv_cdf(0.5 + level / 2)
