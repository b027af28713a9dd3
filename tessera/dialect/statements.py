"""What a statement says, as data."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..model import Family, Group
from ..plans.spec import RowInterval, ScanSpec


@dataclass(frozen=True)
class Select:
    table: str
    spec: ScanSpec
    display_timestamps: bool = False
    escape: bool = True
    into: str | None = None


@dataclass(frozen=True)
class Insert:
    table: str
    values: tuple[tuple[int | None, str, str, str], ...]  # (ts, row, column, value)


@dataclass(frozen=True)
class Delete:
    table: str
    row: str
    columns: tuple[str, ...]  # empty: the whole row
    ts: int | None = None


@dataclass(frozen=True)
class CreateTable:
    table: str
    families: tuple[Family, ...] = ()
    groups: tuple[Group, ...] = ()
    compressor: str = ""
    in_memory: bool = False
    blocksize: int = 0
    ttl: int = 0
    max_versions: int = 0
    like: str | None = None


@dataclass(frozen=True)
class AlterTable:
    table: str
    steps: tuple[tuple, ...] = ()


@dataclass(frozen=True)
class DropTable:
    table: str
    if_exists: bool = False


@dataclass(frozen=True)
class Describe:
    table: str
    with_ids: bool = False


@dataclass(frozen=True)
class ShowCreate:
    table: str


@dataclass(frozen=True)
class ShowTables:
    pass


@dataclass(frozen=True)
class Help:
    topic: str = ""


@dataclass(frozen=True)
class LoadOptions:
    row_key: tuple[str, ...] = ()
    timestamp_column: str | None = None
    header_file: str | None = None
    uniquify: int = 0
    dup_key_cols: bool = False
    escape: bool = True


@dataclass(frozen=True)
class LoadData:
    source: str
    table: str | None = None
    into: str | None = None
    options: LoadOptions = field(default_factory=LoadOptions)


@dataclass(frozen=True)
class Update:
    table: str
    source: str


@dataclass(frozen=True)
class CreateScanner:
    table: str
    range: RowInterval
    spec: ScanSpec
    display_timestamps: bool = False


@dataclass(frozen=True)
class FetchScanblock:
    scanner: int | None = None


@dataclass(frozen=True)
class DestroyScanner:
    scanner: int | None = None


@dataclass(frozen=True)
class Dump:
    path: str
    keys: bool = True


@dataclass(frozen=True)
class Administrative:
    """Statements about servers, ranges and recovery, which Spark has no use for."""

    what: str
