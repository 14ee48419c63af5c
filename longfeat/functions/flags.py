"""0/1 columns carried as bits of a few long columns until the last projection.

An indicator pivot over n names needs n aggregate buffers, or two shuffles with ``pivot``. Kept as bits, the same
pivot is one ``bit_or`` per 62 names: a hash aggregate with map-side combine whose shuffled rows stay narrow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 62
PREFIX = "packed_"


def word_names(n: int, prefix: str = PREFIX) -> list[str]:
    """Names of the long columns that hold n flags."""
    return [f"{prefix}{w}" for w in range(-(-n // BITS))]


def bit(position: Column) -> Column:
    """A long with one bit set."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position.cast("int"))


def slot_of(name: Column, names: Sequence[str]) -> Column:
    """Zero-based place of a name in the list; null for an unknown name."""
    listed = F.array(*[F.lit(n) for n in names])
    return F.nullif(F.array_position(listed, name), F.lit(0).cast("bigint")) - 1


def or_words(slot: Column, n: int, prefix: str = PREFIX) -> list[Column]:
    """Aggregates that set the bit of every slot met in the group."""
    word, offset = F.floor(slot / BITS), slot % BITS
    return [
        F.bit_or(F.when(word == w, bit(offset)).otherwise(F.lit(0).cast("bigint"))).alias(name)
        for w, name in enumerate(word_names(n, prefix))
    ]


def merge_words(n: int, prefix: str = PREFIX) -> list[Column]:
    """Aggregates that merge packed columns."""
    return [F.bit_or(c).alias(c) for c in word_names(n, prefix)]


def is_set(slot: int, prefix: str = PREFIX) -> Column:
    """Boolean: the flag in this slot is set (false where the packed column is null)."""
    return F.expr(f"{flag_text(slot, prefix)} = 1")


def flag_text(slot: int, prefix: str = PREFIX) -> str:
    """SQL text of a flag's 0/1 value; as text, a thousand of them reach the JVM in one call."""
    return f"cast(getbit(coalesce({prefix}{slot // BITS}, 0L), {slot % BITS}) as int)"


def unpack(df: DataFrame, names: Sequence[str], prefix: str = PREFIX) -> DataFrame:
    """Replace the packed columns by one 0/1 int column per name."""
    words = set(word_names(len(names), prefix))
    kept = [f"`{c}`" for c in df.columns if c not in words]
    return df.selectExpr(*kept, *[f"{flag_text(i, prefix)} as `{n}`" for i, n in enumerate(names)])
