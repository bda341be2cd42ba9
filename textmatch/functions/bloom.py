"""Bloom filters: built by partial aggregates over words of 64 bits, held as a small object on the driver, tested as a column.

The size is known before: -n ln p / ln(2)^2 bits. A filter above MAX_BITS is refused, since it travels with the plan; a semi join, to which
Spark adds a filter of its own at run time, is the way beyond that."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BITS = 1 << 25


def shape(n: int, p: float = 0.01) -> tuple[int, int]:
    """Bits and hashes for n items at a false positive rate of p."""
    bits = max(1, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return bits, max(1, math.ceil(bits / max(1, n) * math.log(2)))


def _positions(text: Column, bits: int, hashes: int) -> Column:
    a, b = F.pmod(F.xxhash64(text), F.lit(bits)), F.pmod(F.xxhash64(F.lit("second"), text), F.lit(bits))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(a + i * b, F.lit(bits)))


class Bloom:
    def __init__(self, bits: int, hashes: int, words: dict[int, int], items: int = 0):
        self.bits, self.hashes, self.words, self.items = bits, hashes, words, items

    @classmethod
    def of(cls, df: DataFrame, column: str, expected: int | None = None, p: float = 0.01) -> Bloom:
        n = expected or df.count()
        bits, hashes = shape(max(1, n), p)
        if bits > MAX_BITS:
            raise ValueError(f"{bits} bits are too many to send along; use a semi join")
        at = df.where(F.col(column).isNotNull()).select(F.explode(_positions(F.col(column).cast("string"), bits, hashes)).alias("at"))
        rows = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 AS int))")).alias("v")).collect()  # bits / 64 rows at most
        return cls(bits, hashes, {r["word"]: r["v"] for r in rows}, n)

    def might_contain(self, text: Column) -> Column:
        held = F.array(*[F.lit(self.words.get(k, 0)).cast("long") for k in range(-(-self.bits // 64))]) if self.bits <= 1 << 16 else None
        if held is None:
            from pyspark.sql import SparkSession

            sent = SparkSession.getActiveSession().sparkContext.broadcast(self.words)  # MAX_BITS at most

            @F.pandas_udf("boolean")
            def test(lists):
                return lists.map(lambda ps: all(sent.value.get(int(p) // 64, 0) >> (int(p) % 64) & 1 for p in ps))

            return test(_positions(text, self.bits, self.hashes))
        bit = lambda p: F.get(held, F.floor(p / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))) != 0
        return F.forall(_positions(text, self.bits, self.hashes), bit)

    def stats(self) -> dict:
        ones = sum((v % (1 << 64)).bit_count() for v in self.words.values())
        return {"bits": self.bits, "hashes": self.hashes, "items": self.items, "ones": ones, "false_positive_rate": (ones / self.bits) ** self.hashes}

    def to_json(self) -> str:
        return json.dumps({"bits": self.bits, "hashes": self.hashes, "items": self.items, "words": {str(k): v for k, v in self.words.items()}})

    @classmethod
    def from_json(cls, text: str) -> Bloom:
        x = json.loads(text)
        return cls(x["bits"], x["hashes"], {int(k): v for k, v in x["words"].items()}, x["items"])
