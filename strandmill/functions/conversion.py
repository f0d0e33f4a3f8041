"""The twelve single-base conversions and the columns built on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMPLEMENT = {"A": "T", "T": "A", "C": "G", "G": "C"}
# fixed values: order of the registry
TAGS = ("ct", "tc", "ag", "ga", "ac", "ca", "gt", "tg", "at", "ta", "cg", "gc")
# fixed values: three-letter codes by merged pair, in the order A C G T
THREE_LETTER = {"CT": "0121", "AG": "1012", "AC": "1102", "GT": "2011", "AT": "1021", "CG": "0112"}


@dataclass(frozen=True)
class Conversion:
    target: str
    converted: str

    @property
    def tag(self) -> str:
        return (self.target + self.converted).lower()

    @property
    def key(self) -> str:
        return f"{self.target}>{self.converted}"

    @property
    def complement_target(self) -> str:
        return COMPLEMENT[self.target]

    @property
    def complement_converted(self) -> str:
        return COMPLEMENT[self.converted]

    @property
    def three_letter(self) -> str:
        return THREE_LETTER["".join(sorted(self.target + self.converted))]

    def description(self) -> str:
        return f"{self.target}-to-{self.converted}"


REGISTRY = {tag: Conversion(*tag.upper()) for tag in TAGS}


def parse_conversion(value: "str | Conversion") -> Conversion:
    """``C>T``, ``c->t``, ``C_T``, ``C-T`` or ``ct``; the letter right behind the first separator counts."""
    if isinstance(value, Conversion):
        return value
    text = str(value).lower().replace(" ", "")
    tries = []
    for mark in ("->", ">", "_", "-"):
        before, found, behind = text.partition(mark)
        if found:
            tries.append(before[:1] + behind[:1])
    tries.append(text[:2])
    for tag in tries:
        if tag in REGISTRY:
            return REGISTRY[tag]
    raise ValueError(f"no conversion: {value!r}; known are {', '.join(c.key for c in REGISTRY.values())}")


def conversion_table(spark: SparkSession) -> DataFrame:
    """The registry as a dimension of twelve rows."""
    rows = [(c.tag, c.key, c.target, c.converted, c.complement_target, c.complement_converted) for c in REGISTRY.values()]
    return spark.createDataFrame(rows, "tag string, key string, from_base string, to_base string, comp_from string, comp_to string")


def three_letter_code(seq: Column, conversion: "str | Conversion") -> Column:
    """Bases as digits 0-2, the pair merged; anything but A, C, G, T is 0."""
    digits = parse_conversion(conversion).three_letter
    return F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "?"), "ACGT?", digits + "0")


def fully_converted(seq: Column, conversion: "str | Conversion") -> Column:
    c = parse_conversion(conversion)
    return F.translate(seq, c.target, c.converted)
