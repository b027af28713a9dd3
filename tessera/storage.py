"""Tables as Parquet segments, with a manifest that is replaced as a whole.

``catalog/`` and each table's ``manifest/`` hold numbered JSON files; the highest
number counts.  A commit writes the next number and fails if it exists, so readers
always see a whole commit and a writer notices that another was first.  A segment
has a folder for each access group, with files sorted by key; markers of whole rows
are in a folder of their own that every scan reads.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field, replace
from itertools import accumulate

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .errors import Conflict, NoSuchTable, TableExists
from .model import CELL_SCHEMA, DELETE_ROW, INSERT, Schema
from .operators import mutate, visibility
from .plans import ScanSpec, planner

ROW_MARKERS = "_rows"
#: Up to so many markers are broadcast; the manifest knows their number.
FEW_MARKERS = 50_000
#: Segments beyond which a merging compaction is due, and how many it merges.
MAX_SEGMENTS, MERGE_SEGMENTS = 20, 5
#: How often a commit is tried when other writers are first.
TRIES = 5
#: Rows of a sorted file, about.
FILE_CELLS = 4_000_000


class Files:
    """Text files in any folder that Hadoop can reach."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """A new file; Conflict if there is one.

        Written aside first, so that nobody reads half of it, and then given its name
        by a step of which only one writer's succeeds: a hard link on a local disk, and
        elsewhere a rename, which Hadoop's file systems refuse where the target exists.
        """
        fs, p = self._at(path)
        aside = self.jvm.org.apache.hadoop.fs.Path(p.getParent(), f"_{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getScheme() == "file":
                at = lambda x: self.jvm.java.io.File(x.toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(at(p), at(aside))
            elif fs.exists(p) or not fs.rename(aside, p):
                raise Conflict(f"{path} was written by somebody else")
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            raise Conflict(f"{path} was written by somebody else") from None
        finally:
            fs.delete(aside, False)

    def write(self, path: str, parts) -> None:
        """A file of texts one after the other."""
        fs, p = self._at(path)
        out = fs.create(p, False)
        for text in parts:
            out.write(bytearray(text.encode()))
        out.close()

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


class Versioned:
    """A JSON value whose every change is a new numbered file."""

    def __init__(self, files: Files, folder: str, empty: dict):
        self.files, self.folder, self.empty = files, folder, empty

    def load(self) -> tuple[int, dict]:
        numbers = [int(n[:-5]) for n in self.files.names(self.folder) if n.endswith(".json") and n[0] != "_"]
        if not numbers:
            return 0, json.loads(json.dumps(self.empty))
        return max(numbers), json.loads(self.files.read(f"{self.folder}/{max(numbers):020d}.json"))

    def commit(self, seen: int, value: dict) -> None:
        """Follow version ``seen``, or fail with Conflict."""
        self.files.create(f"{self.folder}/{seen + 1:020d}.json", json.dumps(value))


@dataclass(frozen=True)
class Segment:
    """What the manifest knows of a segment; enough to skip it."""

    path: str
    groups: tuple[str, ...]
    cells: int
    markers: int
    min_row: str
    max_row: str
    min_rev: int
    max_rev: int
    min_ts: int
    max_ts: int


@dataclass(frozen=True)
class Manifest:
    segments: tuple[Segment, ...] = ()
    next_rev: int = 1
    last_ts: int = 0
    batches: dict[str, int] = field(default_factory=dict)  # of each stream, the last batch committed

    @staticmethod
    def of(data: dict) -> Manifest:
        return Manifest(tuple(Segment(**{**s, "groups": tuple(s["groups"])}) for s in data["segments"]), data["next_rev"], data["last_ts"], data["batches"])


@dataclass
class Table:
    """A table of the store: its schema now, and its segments."""

    store: Store
    name: str
    id: int
    schema: Schema
    folder: str = field(init=False)

    def __post_init__(self):
        self.folder = f"{self.store.root}/tables/{self.id}"
        self._versions = Versioned(self.store.files, f"{self.folder}/manifest", asdict(Manifest()))

    def manifest(self) -> Manifest:
        return Manifest.of(self._versions.load()[1])

    # -- writing

    def append(self, cells: DataFrame, stamp: bool = False, batch: tuple[str, int] | None = None) -> Segment | None:
        """Commit ``cells``; with ``stamp``, ``rev`` and where it is null ``ts`` are given here.

        ``batch``: a stream's name and the number of its batch; one that was committed
        before is left out.

        Cells to stamp are written aside first, each with its place in its partition, and
        the partitions' counts make that a number without gaps: revisions follow those of
        earlier commits and, within this one, the order of partitions and rows, and so do
        automatic timestamps, which begin at the clock's and after any earlier one.  If
        another writer commits first, what lies aside is stamped again, ``TRIES`` times
        at most; the last Conflict is raised, and then nothing was written.
        """
        if not stamp:
            return self._committed(lambda now, base: cells, 0, batch)
        aside = f"{self.folder}/aside/{uuid.uuid4().hex}"
        try:
            place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
            cells.withColumns({"part": F.spark_partition_id(), "place": place}).write.parquet(aside)
            rows = self.store.spark.read.parquet(aside)
            # a row a task of the load
            counts = sorted((r["part"], r["count"]) for r in rows.groupBy("part").count().collect())
            begins = dict(zip((p for p, _ in counts), accumulate((n for _, n in counts), initial=0)))
            total = sum(n for _, n in counts)
            if not total:
                return None
            starts = F.broadcast(self.store.spark.createDataFrame(list(begins.items()), "part int, begin long"))
            numbered = rows.join(starts, "part").withColumn("n", F.col("begin") + F.col("place"))

            def stamped(now: Manifest, base: int) -> DataFrame:
                return numbered.withColumns({"rev": F.lit(now.next_rev) + F.col("n"), "ts": F.coalesce("ts", F.lit(base) + F.col("n"))})

            return self._committed(stamped, total, batch)
        finally:
            self.store.files.remove(aside)

    def put(self, cells: list[tuple]) -> Segment | None:
        """Commit a list of cells made by ``mutate.insert`` and ``mutate.marker``, in their order."""

        def stamped(now: Manifest, base: int) -> DataFrame:
            return mutate.frame(self.store.spark, mutate.stamped(cells, now.next_rev, base))

        return self._committed(stamped, len(cells)) if cells else None

    def _committed(self, stamped, total: int, batch: tuple[str, int] | None = None) -> Segment | None:
        """Write ``stamped(manifest, first automatic time)`` as a segment and commit it; ``total``: cells that got stamps."""
        for attempt in range(TRIES):
            seen, data = self._versions.load()
            now = Manifest.of(data)
            if batch and batch[1] <= now.batches.get(batch[0], -1):
                return None
            base = max(self.store.clock(), now.last_ts + 1)
            cells = stamped(now, base)
            segment = self._write(cells.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CELL_SCHEMA]))
            if segment is None:
                return None
            # explicit times don't move the clock
            last = base + total if total else now.last_ts
            batches = now.batches | (dict([batch]) if batch else {})
            new = Manifest((*now.segments, segment), max(now.next_rev + total, segment.max_rev + 1), last, batches)
            try:
                self._versions.commit(seen, asdict(new))
                break
            except Conflict:
                self.store.files.remove(segment.path)
                if attempt == TRIES - 1:
                    raise
        self.maintain()
        return segment

    def _write(self, cells: DataFrame) -> Segment | None:
        path = f"{self.folder}/segments/{uuid.uuid4().hex}"
        names = {g.name: [f.id for f in self.schema.families if f.name in g.families] for g in self.schema.groups}
        # groups that are written alike go out in one pass over the cells
        alike: dict[tuple, list[str]] = {}
        for g in self.schema.groups:
            alike.setdefault(tuple(sorted(g.writer_options().items())), []).append(g.name)
        total: dict[str, list] = {}
        for k, (options, groups) in enumerate(alike.items()):
            group = F.lit(None).cast("string")
            for name in groups:
                group = F.when(F.col("cf_id").isin(names[name]), F.lit(name)).otherwise(group)
            if k == 0:
                group = F.when(F.col("flag") == DELETE_ROW, F.lit(ROW_MARKERS)).otherwise(group)
            part = cells.withColumn("ag", group).filter(F.col("ag").isNotNull())
            # by more than the row, so that a wide row is more than one task
            part = part.repartitionByRange("row", "cf_id", "cq")
            part = part.sortWithinPartitions("row", "cf_id", "cq", "flag", F.desc("ts"), F.desc("rev"))
            seen = Observation()
            part = part.observe(
                seen,
                F.count(F.lit(1)).alias("n"),
                F.count(F.when(F.col("flag") != INSERT, 1)).alias("markers"),
                F.min("row").alias("min_row"),
                F.max("row").alias("max_row"),
                *[f(c).alias(f"{name}_{c}") for name, f in (("min", F.min), ("max", F.max)) for c in ("rev", "ts")],
                F.collect_set("ag").alias("groups"),
            )
            writer = part.write.mode("append").options(**dict(options)).option("maxRecordsPerFile", FILE_CELLS)
            writer.partitionBy("ag").parquet(path)
            for key, value in seen.get.items():
                total.setdefault(key, []).append(value)
        if not sum(total["n"]):
            self.store.files.remove(path)
            return None
        known = {k: [x for x in v if x is not None] for k, v in total.items()}
        rows = [min(x.encode() for x in known["min_row"]).decode(), max(x.encode() for x in known["max_row"]).decode()]
        revs, times = [min(known["min_rev"]), max(known["max_rev"])], [min(known["min_ts"]), max(known["max_ts"])]
        held = tuple(sorted({g for x in total["groups"] for g in x}))
        return Segment(path, held, sum(total["n"]), sum(total["markers"]), *rows, *revs, *times)

    # -- reading

    def cells(self, segments: tuple[Segment, ...] | None = None, groups: set[str] | None = None) -> DataFrame:
        """All stored cells of ``segments`` (all by default) in ``groups`` (all by default), markers included."""
        spark = self.store.spark
        segments = self.manifest().segments if segments is None else segments
        paths = [f"{s.path}/ag={g}" for s in segments for g in s.groups if groups is None or g in groups or g == ROW_MARKERS]
        if not paths:
            return spark.createDataFrame([], CELL_SCHEMA)
        return spark.read.schema(CELL_SCHEMA).parquet(*paths)

    def scan(self, spec: ScanSpec = ScanSpec(), now_ns: int | None = None, wide_rows: bool = False) -> DataFrame:
        """What ``spec`` sees now.  Segments and groups that can't matter aren't opened.

        ``wide_rows``: a row may hold more cells than a task should take.
        """
        manifest = self.manifest()
        hulls = [r.hull() for r in spec.rows] or [planner._cell_rows(c).hull() for c in spec.cells]
        near = lambda s: not hulls or any((high is None or s.min_row.encode() <= high) and s.max_row.encode() >= low for low, high in hulls)
        segments = tuple(s for s in manifest.segments if near(s) and (spec.as_of is None or s.min_rev <= spec.as_of))
        names = [n for n in (spec.families or [f.name for f in self.schema.live()]) if self.schema.family(n)]
        groups = {self.schema.group_of(n) for n in names}
        markers = sum(s.markers for s in segments)
        return planner.scan(self.cells(segments, groups), self.schema, spec, self.store.clock() if now_ns is None else now_ns, has_deletes=markers > 0, few_markers=markers <= FEW_MARKERS, wide_rows=wide_rows)

    # -- maintenance

    def compact(self, major: bool = True, now_ns: int | None = None) -> None:
        """Rewrite segments: all of them without what can't be seen any more, or the smallest few as they are."""
        seen, data = self._versions.load()
        now = Manifest.of(data)
        if major:
            chosen = now.segments
            markers = sum(x.markers for x in chosen)
            how = {"has_deletes": markers > 0, "few_markers": markers <= FEW_MARKERS, "wide_rows": True}
            clock = self.store.clock() if now_ns is None else now_ns
            kept = visibility.major(self.cells(chosen), self.schema.live(), clock, **how)
        else:
            chosen = tuple(sorted(now.segments, key=lambda s: s.cells)[:MERGE_SEGMENTS])
            kept = self.cells(chosen)
        if not chosen or not major and len(chosen) < 2:
            return
        segment = self._write(kept)
        rest = tuple(s for s in now.segments if s not in chosen)
        try:
            self._versions.commit(seen, asdict(replace(now, segments=rest + ((segment,) if segment else ()))))
        except Conflict:
            if segment:
                self.store.files.remove(segment.path)
            raise

    def maintain(self) -> bool:
        """A merging compaction if there are too many segments; every commit of cells asks for it.

        If another writer commits meanwhile it is left to that one.
        """
        if len(self.manifest().segments) <= MAX_SEGMENTS:
            return False
        try:
            self.compact(major=False)
        except Conflict:
            return False
        return True

    def vacuum(self) -> list[str]:
        """Remove segments that the manifest doesn't list; readers of older versions lose them."""
        listed = {s.path.rsplit("/", 1)[1] for s in self.manifest().segments}
        gone = [n for n in self.store.files.names(f"{self.folder}/segments") if n not in listed]
        for n in gone:
            self.store.files.remove(f"{self.folder}/segments/{n}")
        return gone


class Store:
    """A folder of tables."""

    def __init__(self, spark: SparkSession, root: str, clock=time.time_ns):
        self.spark, self.root, self.clock, self.files = spark, root.rstrip("/"), clock, Files(spark)
        self._catalog = Versioned(self.files, f"{self.root}/catalog", {"next_id": 1, "tables": {}})

    def tables(self) -> list[str]:
        return sorted(self._catalog.load()[1]["tables"])

    def table(self, name: str) -> Table:
        entry = self._catalog.load()[1]["tables"].get(name)
        if entry is None:
            raise NoSuchTable(f"table '{name}' does not exist")
        return Table(self, name, entry["id"], Schema.from_json(entry["schema"]))

    def create(self, name: str, schema: Schema) -> Table:
        seen, data = self._catalog.load()
        if name in data["tables"]:
            raise TableExists(f"table '{name}' already exists")
        data["tables"][name] = {"id": data["next_id"], "schema": schema.to_json()}
        data["next_id"] += 1
        self._catalog.commit(seen, data)
        return self.table(name)

    def alter(self, name: str, schema: Schema) -> Table:
        """Replace a schema by one of the next generation."""
        seen, data = self._catalog.load()
        if name not in data["tables"]:
            raise NoSuchTable(f"table '{name}' does not exist")
        if schema.generation != data["tables"][name]["schema"]["generation"] + 1:
            raise Conflict(f"the schema of '{name}' was changed by somebody else")
        data["tables"][name]["schema"] = schema.to_json()
        self._catalog.commit(seen, data)
        return self.table(name)

    def drop(self, name: str, if_exists: bool = False) -> bool:
        seen, data = self._catalog.load()
        entry = data["tables"].pop(name, None)
        if entry is None:
            if if_exists:
                return False
            raise NoSuchTable(f"table '{name}' does not exist")
        self._catalog.commit(seen, data)
        self.files.remove(f"{self.root}/tables/{entry['id']}")
        return True
