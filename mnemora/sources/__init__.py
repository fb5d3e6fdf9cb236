"""Readers of messages, tables and settings."""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemora import schemas, storage


def stored_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table on any storage, or an empty one of the schema where nothing is stored yet."""
    return storage.stored(spark, path, schema)


def documents_json(spark: SparkSession, path: str) -> DataFrame:
    """Posted documents, one JSON object per line; unknown members are dropped."""
    return spark.read.schema(schemas.DOCUMENT).json(path)


def documents_from_messages(messages: DataFrame, column: str = "value") -> DataFrame:
    """Documents from a column of JSON texts; broken ones give no row."""
    return messages.select(F.from_json(F.col(column), schemas.DOCUMENT).alias("d")).where("d is not null and d.url is not null").select("d.*")


def documents_from_form(form: DataFrame) -> DataFrame:
    """Documents from form fields: address, title and text; the rest is empty."""
    return form.select("url", "title", "text", F.lit("").alias("html"), F.lit("").alias("favicon"))


def clicks_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CLICK).json(path)


def queries_from_messages(column: Column) -> Column:
    """Query messages; null for broken ones and for a null message."""
    return F.from_json(column, schemas.QUERY)


# The places and defaults of the settings.
PLACES = ("~/.mnemorarc", "~/.config/mnemora/config.yml")
DIRECTORY, SEARCH_URL, LOG_LEVEL = "~/.config/mnemora", "https://google.com/search?q={query}", "info"
ADDRESS, DATABASE = "127.0.0.1:4433", "db"
#: Section of the file in which a setting stands.
SECTIONS = {"directory": "app", "search_url": "app", "log_level": "app", "address": "server", "base_url": "server", "database": "server"}


def parse_yaml(text: str) -> dict:
    """The part of YAML that settings need: nested maps by indentation, plain or quoted values, comments."""
    root: dict = {}
    open_: list[tuple[int, dict]] = [(-1, root)]
    for number, line in enumerate(text.splitlines(), 1):
        bare = line.strip()
        if not bare or bare[0] == "#" or bare == "---":
            continue
        depth = len(line) - len(line.lstrip(" "))
        m = re.match(r"""([A-Za-z_][\w-]*|"[^"]*"|'[^']*')\s*:(?:\s+(.*))?$""", bare)
        if not m or "\t" in line[:depth]:
            raise ValueError(f"line {number} of the settings isn't a key with a value: {bare!r}")
        key, value = m.group(1).strip("\"'"), (m.group(2) or "").strip()
        while open_[-1][0] >= depth:
            open_.pop()
        parent = open_[-1][1]
        if not value or value[0] == "#":
            parent[key] = child = {}
            open_.append((depth, child))
        elif value[0] in "\"'":
            parent[key] = value[1 : value.index(value[0], 1)]
        else:
            parent[key] = re.split(r"\s#", value, maxsplit=1)[0].rstrip()
    return root


@dataclass(frozen=True)
class Config:
    directory: str = DIRECTORY
    search_url: str = SEARCH_URL
    log_level: str = LOG_LEVEL
    address: str = ADDRESS
    base_url: str = ""
    database: str = DATABASE

    def checked(self) -> Config:
        """With the default base address, which must have a scheme and a host."""
        base = (self.base_url or f"http://{self.address}").removesuffix("/")
        scheme, sep, rest = base.partition("://")
        if not (scheme and sep and rest.split("/")[0]):
            raise ValueError(f"base_url needs a scheme and a host: {base!r}")
        return replace(self, base_url=base)

    def full_path(self, name: str) -> str:
        """Absolute names stay, names that begin with a dot are relative to the folder of the program, others to the
        application's."""
        if name.startswith("/"):
            return name
        return str(Path(sys.argv[0]).resolve().parent / name) if name.startswith(".") else str(Path(self.directory).expanduser() / name)

    @classmethod
    def load(cls, path: str | None = None) -> Config:
        """From the given file, else the first of the usual places, else defaults. These are files of the machine on
        which the driver runs."""
        for p in [path] if path else PLACES:
            file = Path(p).expanduser()
            if file.exists():
                return cls.parse(file.read_text())
            if path:
                raise FileNotFoundError(path)
        return cls().checked()

    @classmethod
    def parse(cls, text: str) -> Config:
        """Settings in their sections; one outside of any section counts as well, one in a wrong section doesn't."""
        tree = parse_yaml(text)
        found = {}
        for name, section in SECTIONS.items():
            inside = tree.get(section)
            value = inside.get(name) if isinstance(inside, dict) and name in inside else tree.get(name)
            if isinstance(value, str):
                found[name] = value
        return cls(**found).checked()

    def write(self, path: str) -> None:
        """Refuses to replace a file."""
        lines = [f"{section}:\n" + "".join(f"  {k}: '{getattr(self, k)}'\n" for k, s in SECTIONS.items() if s == section) for section in dict.fromkeys(SECTIONS.values())]
        with open(path, "x") as f:
            f.write("".join(lines))
