"""Check digits of identity and card numbers, for Python values and for columns."""

from __future__ import annotations

from functools import lru_cache
from itertools import cycle

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the permutation that Verhoeff's scheme applies once more at each place.
PERMUTATION = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def compose(x: int, y: int) -> int:
    """Product of two elements of the dihedral group of order ten: turns 0 to 4, flips 5 to 9."""
    turn = x + y if x < 5 else x - y
    return turn % 5 + (5 if (x < 5) != (y < 5) else 0)


@lru_cache(maxsize=1)
def verhoeff_steps() -> tuple[tuple[int, ...], ...]:
    """For each of the eight places, the next state by ``10 * state + digit``."""
    image, steps = list(range(10)), []
    for _ in range(8):
        steps.append(tuple(compose(state, image[digit]) for state in range(10) for digit in range(10)))
        image = [PERMUTATION[x] for x in image]
    return tuple(steps)


def verhoeff_ok(digits: str) -> bool:
    state = 0
    for step, digit in zip(cycle(verhoeff_steps()), map(int, digits[::-1])):
        state = step[10 * state + digit]
    return state == 0


def verhoeff_valid(digits: Column) -> Column:
    """Whether a string of digits ends in its Verhoeff check digit."""
    steps = F.array(*[F.lit(x) for step in verhoeff_steps() for x in step])
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda state, i: F.get(steps, (i % 8) * 100 + state * 10 + digit(i))) == 0


def luhn_ok(digits: str) -> bool:
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0
