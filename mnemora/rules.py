"""Skip and priority patterns and keyword aliases. A Rules value is immutable; changes give a new one."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora import schemas, storage


def combined(patterns: tuple[str, ...]) -> str | None:
    """One alternation of all patterns; None for none, which matches nothing."""
    return "|".join(f"({p})" for p in patterns) if patterns else None


def matches(url: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any pattern is found in the value; a broken list matches nothing."""
    one = combined(patterns)
    if one and storage.regex_error(one):
        one = None
    return F.coalesce(url.rlike(one), F.lit(False)) if one else F.lit(False)


@dataclass(frozen=True)
class Rules:
    skip: tuple[str, ...] = ()
    priority: tuple[str, ...] = ()
    aliases: dict[str, str] = field(default_factory=dict)

    def is_skipped(self, url: Column) -> Column:
        """On the address as it is written."""
        return matches(url, self.skip)

    def is_priority(self, url: Column) -> Column:
        """On the address as it is indexed, in lower case."""
        return matches(F.lower(url), self.priority)

    def resolve(self, query: str) -> str:
        """Whole words replaced by their aliases, once; the text is left as it is if no word has one."""
        words = query.split()
        if not any(w in self.aliases for w in words):
            return query
        return " ".join(self.aliases.get(w, w) for w in words)

    def resolve_column(self, query: Column) -> Column:
        if not self.aliases:
            return query
        table = F.create_map(*[F.lit(x) for kv in sorted(self.aliases.items()) for x in kv])
        words = F.filter(F.split(query, r"\s+"), lambda x: x != "")
        hit = F.exists(words, lambda w: table[w].isNotNull())
        return F.when(hit, F.array_join(F.transform(words, lambda w: F.coalesce(table[w], w)), " ")).otherwise(query)

    def with_patterns(self, skip: str, priority: str) -> Rules:
        """From text fields: patterns are separated by white space."""
        new = replace(self, skip=tuple(skip.split()), priority=tuple(priority.split()))
        new.check()
        return new

    def with_alias(self, keyword: str, value: str) -> Rules:
        return replace(self, aliases={**self.aliases, keyword: value}) if keyword and value else self

    def without_alias(self, keyword: str) -> Rules:
        if keyword not in self.aliases:
            raise KeyError(keyword)
        return replace(self, aliases={k: v for k, v in self.aliases.items() if k != keyword})

    def check(self) -> None:
        """Refuses patterns that the engine which runs them can't read."""
        for p in (*self.skip, *self.priority):
            if wrong := storage.regex_error(p):
                raise ValueError(f"pattern {p!r}: {wrong}")

    def to_json(self) -> str:
        return json.dumps({"skip": list(self.skip), "priority": list(self.priority), "aliases": self.aliases}, indent=4)

    @classmethod
    def from_json(cls, text: str) -> Rules:
        """Missing and null members are empty."""
        x = json.loads(text) or {}
        rules = cls(tuple(x.get("skip") or ()), tuple(x.get("priority") or ()), dict(x.get("aliases") or {}))
        rules.check()
        return rules

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Rules:
        """Reads the file; writes an empty one first where there is none."""
        text = storage.read_text(spark, path)
        if text is None:
            cls().save(spark, path)
            return cls()
        return cls.from_json(text)

    def save(self, spark: SparkSession, path: str) -> None:
        """Patterns are checked before anything is written."""
        self.check()
        storage.write_text(spark, path, self.to_json())

    def listed(self, spark: SparkSession) -> DataFrame:
        """(kind, name, value): one row per pattern and alias."""
        rows = [("skip", None, p) for p in self.skip] + [("priority", None, p) for p in self.priority] + [("alias", k, v) for k, v in sorted(self.aliases.items())]
        return spark.createDataFrame(rows, "kind string, name string, value string")


def parse(column: Column) -> Column:
    """JSON text of rules as a struct with empty defaults."""
    r = F.from_json(column, schemas.RULES)
    none = F.array().cast("array<string>")
    return F.struct(F.coalesce(r["skip"], none).alias("skip"), F.coalesce(r["priority"], none).alias("priority"), F.coalesce(r["aliases"], F.create_map().cast("map<string,string>")).alias("aliases"))
