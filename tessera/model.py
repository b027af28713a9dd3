"""Cells, column families and table schemas."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import asdict, dataclass, replace

from pyspark.sql import types as T

from .errors import BadKey, SchemaError

# The flags of a cell.
DELETE_ROW, DELETE_FAMILY, DELETE_CELL, INSERT = 0, 1, 2, 255
#: Family ids are never given out again, so dropped families count too.
MAX_FAMILIES = 255

CELL_SCHEMA = T.StructType(
    [
        T.StructField("row", T.StringType(), False),
        T.StructField("cf", T.StringType(), False),
        T.StructField("cf_id", T.ShortType(), False),
        T.StructField("cq", T.StringType(), False),
        T.StructField("ts", T.LongType(), False),  # nanoseconds since 1970
        T.StructField("rev", T.LongType(), False),
        T.StructField("flag", T.ShortType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)
#: In which cells lie side by side; newer versions first.
KEY_ORDER = ("row", "cf_id", "cq", "flag", "-ts", "-rev")

#: The Parquet codec that stands in for each compressor name.
CODECS = {"": "zstd", "none": "uncompressed", "zlib": "gzip", "lzo": "lz4", "quicklz": "snappy", "bmz": "zstd"}


def split_column(column: str) -> tuple[str, str | None]:
    """Family and qualifier at the first colon; the qualifier is None without a colon."""
    family, colon, qualifier = column.partition(":")
    return family, qualifier if colon else None


def check_row(row: str | None) -> str:
    """A row key: not empty, no NUL, not of the range kept for end markers."""
    if not row:
        raise BadKey("a row key can't be empty")
    if "\0" in row:
        raise BadKey("a row key can't hold NUL")
    if row.encode("utf-8", "surrogateescape").startswith(b"\xff\xff"):
        raise BadKey("a row key can't start with the end marker")
    return row


@dataclass(frozen=True)
class Family:
    name: str
    id: int = 0
    max_versions: int = 0
    ttl: int = 0  # seconds; 0: for ever
    generation: int = 1
    deleted: bool = False


@dataclass(frozen=True)
class Group:
    """Families stored together."""

    name: str
    families: tuple[str, ...] = ()
    in_memory: bool = False
    blocksize: int = 0
    compressor: str = ""
    bloom: str = ""

    def writer_options(self) -> dict[str, str]:
        """Parquet options for the group's segments."""
        options = {"compression": CODECS[self.compressor.split()[0] if self.compressor else ""]}
        if self.blocksize:
            options["parquet.page.size"] = str(self.blocksize)
        kind, *rest = self.bloom.split() or [""]
        if kind in ("rows", "rows+cols"):
            for column in ("row",) if kind == "rows" else ("row", "cq"):
                options[f"parquet.bloom.filter.enabled#{column}"] = "true"
                if "--false-positive" in rest:
                    options[f"parquet.bloom.filter.fpp#{column}"] = rest[rest.index("--false-positive") + 1]
                if "--max-approx-items" in rest:
                    options[f"parquet.bloom.filter.expected.ndv#{column}"] = rest[rest.index("--max-approx-items") + 1]
        return options


def _check_compressor(text: str) -> str:
    if text and text.split()[0] not in CODECS:
        raise SchemaError(f"unknown compressor '{text}'")
    return text


def _check_bloom(text: str) -> str:
    if text and text.split()[0] not in ("rows", "rows+cols", "none"):
        raise SchemaError(f"unknown bloom filter '{text}'")
    return text


def quoted(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z0-9]+", name) else f"'{name}'"


@dataclass(frozen=True)
class Schema:
    """A table's families and groups; every change makes a new one of the next generation."""

    families: tuple[Family, ...] = ()
    groups: tuple[Group, ...] = ()
    compressor: str = ""
    generation: int = 1

    @staticmethod
    def define(families: list[Family], groups: list[Group] = (), compressor: str = "", in_memory: bool = False, blocksize: int = 0, ttl: int = 0, max_versions: int = 0) -> Schema:
        """A new table.  Table options are defaults of its groups and families.

        Families outside any group go to the group ``default``.  Ids follow the order
        of groups and of families in them, which is why that order shows.
        """
        named = {}
        for f in families:
            if f.name in named:
                raise SchemaError(f"column family '{f.name}' multiply defined")
            named[f.name] = replace(f, max_versions=f.max_versions or max_versions, ttl=f.ttl or ttl)
        groups = _placed(list(groups), list(named))
        ready = [replace(g, in_memory=g.in_memory or in_memory, blocksize=g.blocksize or blocksize) for g in groups]
        for g in ready:
            _check_compressor(g.compressor)
            _check_bloom(g.bloom)
        order = [n for g in ready for n in g.families]
        if len(order) > MAX_FAMILIES:
            raise SchemaError(f"too many column families, the most is {MAX_FAMILIES}")
        return Schema(tuple(replace(named[n], id=i + 1) for i, n in enumerate(order)), tuple(ready), _check_compressor(compressor))

    def alter(self, steps: list[tuple]) -> Schema:
        """``steps``: ``("add", families, groups)`` and ``("drop", names)``, in order."""
        families, groups = list(self.families), list(self.groups)
        generation = self.generation + 1
        for kind, *what in steps:
            if kind == "drop":
                for name in what[0]:
                    live = next((k for k, f in enumerate(families) if f.name == name and not f.deleted), None)
                    if live is None:
                        raise SchemaError(f"column family '{name}' is not defined")
                    families[live] = replace(families[live], deleted=True, generation=generation)
                continue
            added, new_groups = what
            for f in added:
                if any(f.name == x.name for x in families):  # a dropped name stays taken
                    raise SchemaError(f"column family '{f.name}' multiply defined")
                if len(families) >= MAX_FAMILIES:
                    raise SchemaError(f"too many column families, the most is {MAX_FAMILIES}")
                families.append(replace(f, id=max((x.id for x in families), default=0) + 1, generation=generation))
            for g in new_groups:
                if any(g.name == x.name for x in groups):
                    raise SchemaError(f"access group '{g.name}' multiply defined")
                _check_compressor(g.compressor)
                _check_bloom(g.bloom)
            groups = _placed([*groups, *new_groups], [f.name for f in families], known={n for g in self.groups for n in g.families})
        return replace(self, families=tuple(families), groups=tuple(groups), generation=generation)

    # -- lookups

    def family(self, name: str) -> Family | None:
        return next((f for f in self.families if f.name == name and not f.deleted), None)

    def live(self) -> list[Family]:
        return [f for f in self.families if not f.deleted]

    def group_of(self, family: str) -> str:
        return next(g.name for g in self.groups if family in g.families)

    # -- text forms

    def to_json(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_json(data: dict) -> Schema:
        return Schema(tuple(Family(**f) for f in data["families"]), tuple(Group(**{**g, "families": tuple(g["families"])}) for g in data["groups"]), data["compressor"], data["generation"])

    def to_ddl(self, table: str) -> str:
        """The CREATE TABLE text; durations are in seconds, dropped families don't show."""
        lines = []
        for f in self.live():
            lines.append(f"  {quoted(f.name)}" + f" MAX_VERSIONS={f.max_versions}" * bool(f.max_versions) + f" TTL={f.ttl}" * bool(f.ttl))
        live = {f.name for f in self.live()}
        for g in self.groups:
            names = [n for n in g.families if n in live]
            if not names:
                continue
            options = " IN_MEMORY" * g.in_memory + f" BLOCKSIZE={g.blocksize}" * bool(g.blocksize)
            options += f' COMPRESSOR="{g.compressor}"' * bool(g.compressor) + f' BLOOMFILTER="{g.bloom}"' * bool(g.bloom)
            lines.append(f"  ACCESS GROUP {quoted(g.name)}{options} ({', '.join(map(quoted, names))})")
        compressor = f'COMPRESSOR="{self.compressor}" ' * bool(self.compressor)
        return f"\nCREATE TABLE {compressor}{table} (\n" + ",\n".join(lines) + "\n)\n"

    def to_xml(self, ids: bool = False) -> str:
        # Element and attribute names of the XML form.
        root = ET.Element("Schema")
        if ids:
            root.set("generation", str(self.generation))
        if self.compressor:
            root.set("compressor", self.compressor)
        by_name = {f.name: f for f in self.families}
        for g in self.groups:
            group = ET.SubElement(root, "AccessGroup", name=g.name)
            attributes = {"inMemory": "true" * g.in_memory, "blksz": str(g.blocksize or ""), "compressor": g.compressor, "bloomFilter": g.bloom}
            for key, value in attributes.items():
                if value:
                    group.set(key, value)
            for name in g.families:
                f = by_name[name]
                family = ET.SubElement(group, "ColumnFamily")
                children = {"Name": name}
                if ids:
                    family.set("id", str(f.id))
                    children = {"Generation": str(f.generation), "Name": name}
                if f.max_versions:
                    children["MaxVersions"] = str(f.max_versions)
                if f.ttl:
                    children["ttl"] = str(f.ttl)
                children["deleted"] = "true" if f.deleted else "false"
                for key, value in children.items():
                    ET.SubElement(family, key).text = value
        ET.indent(root)
        return ET.tostring(root, encoding="unicode", short_empty_elements=False) + "\n"

    @staticmethod
    def from_xml(text: str) -> Schema:
        """A schema from its XML form; whatever the form doesn't have is an error."""
        try:
            root = ET.fromstring(text)
        except ET.ParseError as e:
            raise SchemaError(f"schema can't be parsed: {e}") from None
        _expect(root, "Schema", {"generation", "compressor"})
        families, groups, with_ids = [], [], False
        for group in root:
            _expect(group, "AccessGroup", {"name", "inMemory", "blksz", "compressor", "bloomFilter"})
            if "name" not in group.attrib:
                raise SchemaError("access group without a name")
            names = []
            for family in group:
                _expect(family, "ColumnFamily", {"id"})
                parts = {}
                for child in family:
                    _expect(child, ("Name", "MaxVersions", "ttl", "deleted", "Generation"), set())
                    if len(child):
                        raise SchemaError(f"'{child.tag}' can't hold elements")
                    if child.tag in parts:
                        raise SchemaError(f"'{child.tag}' multiply defined")
                    parts[child.tag] = (child.text or "").strip()
                if not parts.get("Name"):
                    raise SchemaError("column family without a name")
                with_ids |= "id" in family.attrib
                families.append(Family(parts["Name"], _count(family.get("id", "0")), _count(parts.get("MaxVersions", "0")), _count(parts.get("ttl", "0")), _count(parts.get("Generation", "1")), _truth(parts.get("deleted", "false"))))
                names.append(parts["Name"])
            groups.append(Group(group.get("name"), tuple(names), _truth(group.get("inMemory", "false")), _count(group.get("blksz", "0")), _check_compressor(group.get("compressor", "")), _check_bloom(group.get("bloomFilter", ""))))
        if len({g.name for g in groups}) < len(groups):
            raise SchemaError("access group multiply defined")
        if with_ids:
            if len({f.name for f in families}) < len(families) or len({f.id for f in families}) < len(families):
                raise SchemaError("column family multiply defined")
            return Schema(tuple(sorted(families, key=lambda f: f.id)), tuple(groups), _check_compressor(root.get("compressor", "")), _count(root.get("generation", "1")))
        return Schema.define(families, groups, root.get("compressor", ""))


def _placed(groups: list[Group], names: list[str], known: set[str] = frozenset()) -> list[Group]:
    """``groups`` such that each name is in one of them; ``known``: names placed before."""
    if len({g.name for g in groups}) < len(groups):
        raise SchemaError("access group multiply defined")
    seen: dict[str, str] = {}
    for g in groups:
        for n in g.families:
            if n not in names:
                raise SchemaError(f"access group '{g.name}' includes unknown column family '{n}'")
            if n in seen:
                raise SchemaError(f"column family '{n}' can belong to only one access group")
            seen[n] = g.name
    rest = tuple(n for n in names if n not in seen and n not in known)
    if rest:
        at = next((k for k, g in enumerate(groups) if g.name == "default"), None)
        if at is None:
            groups = [*groups, Group("default", rest)]
        else:
            groups = [*groups[:at], replace(groups[at], families=groups[at].families + rest), *groups[at + 1 :]]
    return groups


def _expect(element, tag, attributes: set[str]) -> None:
    if element.tag != tag and element.tag not in (tag if isinstance(tag, tuple) else ()):
        raise SchemaError(f"unexpected element '{element.tag}'")
    for name in element.attrib:
        if name not in attributes:
            raise SchemaError(f"unexpected attribute '{name}' of '{element.tag}'")


def _count(text: str) -> int:
    if not re.fullmatch(r"[0-9]+", text):
        raise SchemaError(f"'{text}' is not a count")
    return int(text)


def _truth(text: str) -> bool:
    if text.lower() not in ("true", "false"):
        raise SchemaError(f"'{text}' is neither true nor false")
    return text.lower() == "true"
