"""A keyed permutation of 0..n-1 in plain integer arithmetic, as DataFrame columns and as SQL text.

A Feistel network over pairs (a, b) with a < A, b < B and A * B just above n: each half round
adds to one half a keyed function of the other, modulo the size of that half, so it can be
undone, and the network permutes 0..A*B-1. Cycle walking repeats it while the value is not
below n, which keeps it a permutation of 0..n-1. As A * B - n < A, about one value in sqrt(n)
walks. All products stay below 2**62.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, functions as F

P, Q = (1 << 31) - 1, (1 << 31) - 19
#: Most steps of a walk; a walk that were longer is an error, never a dropped row.
WALK = 256
Key = tuple[int, int, int, int]


def keys(seed: int, count: int) -> list[Key]:
    """Four constants below the primes for each half round, from a seed."""
    value, made = seed % P or 1, []
    for _ in range(4 * count + 8):
        value = value * 48271 % P
        made.append(value)
    return [tuple(made[8 + 4 * i:12 + 4 * i]) for i in range(count)]


def mixed(x: Column, key: Key) -> Column:
    """A keyed function of a value from 0 to P."""
    return ((x * key[0] + key[1]) % P).bitwiseXOR(F.lit(key[2])) * key[3] % Q


def mixed_sql(x: str, key: Key) -> str:
    return f"(xor(({x} * {key[0]} + {key[1]}) % {P}, {key[2]}::BIGINT) * {key[3]} % {Q})"


def halves(n: int) -> tuple[int, int]:
    """Sizes of the two halves for n values."""
    a = isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def inline(x: Column, n: int, seed: int, rounds: int) -> Column:
    """One pass of the network as one expression."""
    size_a, size_b = halves(n)
    a, b = F.call_function("div", x, F.lit(size_b)), x % size_b
    for i, key in enumerate(keys(seed, 2 * rounds)):
        if i % 2:
            b = (b + mixed(a, key)) % size_b
        else:
            a = (a + mixed(b, key)) % size_a
    return a * size_b + b


def permuted(df: DataFrame, column: str, n: int, seed: int, rounds: int = 3) -> DataFrame:
    """Replaces a column of values 0..n-1 by their places in the permutation."""
    once = df.withColumn(column, inline(F.col(column), n, seed, rounds).cast("long"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.col(column), lambda x, _: F.when(
        x < n, x).otherwise(inline(x, n, seed, rounds).cast("long")))
    end = F.when(F.col(column) < n, F.col(column)).otherwise(walk)
    return once.withColumn(column, end).withColumn(column, F.when(F.col(column) < n, F.col(column)).otherwise(
        F.raise_error(F.lit("a cycle walk did not end"))))


def network_sql(x: str, size_a: str, size_b: str, seed: int, rounds: int = 3) -> str:
    """The same pass as SQL text; the sizes are SQL too."""
    a, b = f"({x} // {size_b})", f"({x} % {size_b})"
    for i, key in enumerate(keys(seed, 2 * rounds)):
        if i % 2:
            b = f"(({b} + {mixed_sql(a, key)}) % {size_b})"
        else:
            a = f"(({a} + {mixed_sql(b, key)}) % {size_a})"
    return f"({a} * {size_b} + {b})"
