"""Index tables on any store that Spark writes: documents, changes, browse, export, snapshots, retention.

An index is a folder of versions `v=N`, each a complete Parquet table, and a change is a new version;
readers of an older one are not disturbed. The largest finished version is current. A writer claims its number
by a file that only one can create, so writers do not meet, and a version that was never finished is passed over.
"""

from __future__ import annotations

import base64
import datetime as dt
import io
import json
import re
import tarfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_DOCUMENT_BYTES = 3 * 1024 * 1024
DAY_DIR = re.compile(r"date=(\d{4}-\d{2}-\d{2})$")


class IndexMissing(LookupError):
    """There is no such index."""


class CursorExpired(ValueError):
    """The cursor belongs to another version of the index."""


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_dir(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, bytes below it) of a folder's entries, sorted; none if it is missing."""
    fs, p = _fs(spark, path), _path(spark, path)
    if not fs.exists(p):
        return []
    return sorted((s.getPath().getName(), fs.getContentSummary(s.getPath()).getLength()) for s in fs.listStatus(p))


def delete(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).delete(_path(spark, path), True)


class Store:
    """Indexes below a base folder."""

    def __init__(self, spark: SparkSession, base: str, id_col: str = "object_id"):
        self.spark, self.base, self.id = spark, base.rstrip("/"), id_col

    def versions(self, name: str) -> list[int]:
        """The finished versions."""
        fs, top = _fs(self.spark, self.base), f"{self.base}/{name}"
        found = [n for n, _ in list_dir(self.spark, top) if re.fullmatch(r"v=\d+", n)]
        return sorted(int(n[2:]) for n in found if fs.exists(_path(self.spark, f"{top}/{n}/_SUCCESS")))

    def _claim(self, name: str) -> int:
        """A version number that no other writer has."""
        fs, top = _fs(self.spark, self.base), f"{self.base}/{name}"
        taken = [int(n[2:]) for n, _ in list_dir(self.spark, top) if re.fullmatch(r"v=\d+", n)] + [int(n) for n, _ in list_dir(
            self.spark, f"{top}/_claims")]
        v = max(taken, default=0) + 1
        while not fs.createNewFile(_path(self.spark, f"{top}/_claims/{v}")):
            v += 1
        return v

    def generation(self, name: str) -> int:
        if not (found := self.versions(name)):
            raise IndexMissing(name)
        return found[-1]

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{name}/v={self.generation(name)}")

    def _write(self, name: str, rows: DataFrame) -> int:
        v = self._claim(name)
        rows.write.parquet(f"{self.base}/{name}/v={v}")
        return v

    def create(self, name: str, schema: str) -> None:
        """Create an empty index; an existing one stays as it is."""
        if not self.exists(name):
            self._write(name, self.spark.createDataFrame([], schema))

    def add(self, name: str, docs: DataFrame) -> int:
        """Add or replace documents by id; the last row of an id counts if docs has a column `seq`."""
        docs = latest(docs, self.id) if "seq" in docs.columns else docs.dropDuplicates([self.id])
        if not self.exists(name):
            return self._write(name, docs)
        old = self.read(name).join(docs.select(self.id), self.id, "left_anti")
        return self._write(name, old.unionByName(docs, allowMissingColumns=True))

    def add_json(self, name: str, path: str, schema: str | None = None) -> int:
        """Add the documents of a folder of JSON lines or arrays."""
        reader = self.spark.read.option("multiLine", path.endswith(".json"))
        return self.add(name, (reader.schema(schema) if schema else reader).json(path))

    def batch(self, name: str, changes: DataFrame) -> int:
        """Apply changes (seq, action, id, fields...) in order; see fold_changes."""
        return self._write(name, fold_changes(self.read(name), changes, self.id))

    def get(self, name: str, ids: Sequence, attributes: Sequence[str] | None = None) -> DataFrame:
        rows = self.read(name).where(F.col(self.id).isin(list(ids)))
        return rows.select(self.id, *[a for a in attributes if a != self.id]) if attributes else rows

    def delete_by(self, name: str, condition: Column) -> int:
        return self._write(name, self.read(name).where(~F.coalesce(condition, F.lit(False))))

    def clear(self, name: str) -> int:
        return self._write(name, self.read(name).limit(0))

    def drop(self, name: str) -> bool:
        return delete(self.spark, f"{self.base}/{name}")

    def copy(self, source: str, target: str) -> int:
        return self._write(target, self.read(source))

    def move(self, source: str, target: str) -> int:
        v = self.copy(source, target)
        self.drop(source)
        return v

    def compact(self, name: str, files: int = 1, keep: int = 1) -> int:
        """Rewrite into few files and delete all but the last `keep` versions."""
        v = self._write(name, self.read(name).coalesce(files))
        for old in self.versions(name)[:-keep]:
            delete(self.spark, f"{self.base}/{name}/v={old}")
        return v

    def indexes(self) -> list[dict]:
        """name, entries, dataSize and fileSize of every index."""
        out = []
        for name, size in list_dir(self.spark, self.base):
            if self.exists(name):
                size = dict(list_dir(self.spark, f"{self.base}/{name}"))[f"v={self.generation(name)}"]
                out.append({"name": name, "entries": self.read(name).count(), "dataSize": size, "fileSize": size,
                    "numberOfPendingTasks": 0})
        return out

    def browse(self, name: str, cursor: str | None = None, per_page: int = 1000, condition: Column
        | None = None) -> tuple[DataFrame, str | None, int]:
        """A page by id, the cursor of the next one (None at the end), and the number of all hits."""
        per_page, now = min(per_page, 1000), self.generation(name)
        after, seen = None, 0
        if cursor:
            got = json.loads(base64.b64decode(cursor))
            if got["generation"] != now:
                raise CursorExpired("Cursor is not valid anymore")
            after, seen = got["after"], got["offset"]
        rows = self.read(name) if condition is None else self.read(name).where(condition)
        total = rows.count()
        # the key of the last row, not an offset, so that a page reads only what follows it
        hits = (rows if after is None else rows.where(F.col(self.id) > F.lit(after))).orderBy(self.id).limit(per_page)
        last = hits.agg(F.max(self.id), F.count(F.lit(1))).first()
        seen += last[1]
        more = None if seen >= total else base64.b64encode(json.dumps(
            {"offset": seen, "after": last[0], "generation": now}).encode()).decode()
        return hits, more, total

    def export(self, name: str, path: str) -> None:
        self.read(name).write.parquet(path)

    def restore(self, name: str, path: str) -> int:
        return self._write(name, self.spark.read.parquet(path))

    def snapshot(self, name: str, most_bytes: int = 256 << 20) -> bytes:
        """The current version's files as a gzip tar, through the driver's memory; a larger index raises ValueError
        and is copied by tasks with export()."""
        top, buffer = f"{self.base}/{name}/v={self.generation(name)}", io.BytesIO()
        if (size := sum(n for _, n in list_dir(self.spark, top))) > most_bytes:
            raise ValueError(f"the index has {size} bytes, a snapshot at most {most_bytes}")
        files = self.spark.read.format("binaryFile").load(top).select("path", "content").toLocalIterator()
        with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
            for f in files:
                info = tarfile.TarInfo(f["path"].rpartition("/")[2])
                info.size = len(f["content"])
                tar.addfile(info, io.BytesIO(f["content"]))
        return buffer.getvalue()

    def load_snapshot(self, name: str, data: bytes) -> int:
        v = self._claim(name)
        top, fs = f"{self.base}/{name}/v={v}", _fs(self.spark, self.base)
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as tar:
            for m in tar.getmembers():
                if m.isfile() and "/" not in m.name:
                    out = fs.create(_path(self.spark, f"{top}/{m.name}"))
                    out.write(bytearray(tar.extractfile(m).read()))
                    out.close()
        fs.create(_path(self.spark, f"{top}/_SUCCESS")).close()
        return v


def latest(changes: DataFrame, id_col: str = "object_id", seq: str = "seq") -> DataFrame:
    """The last row of every id, as a partial aggregation rather than a sort."""
    others = [c for c in changes.columns if c not in (id_col, seq)]
    return changes.groupBy(id_col).agg(F.max_by(F.struct(*others), seq).alias("row"), F.max(seq).alias(seq)).select(id_col,
        "row.*", seq).drop(seq)


def fold_changes(docs: DataFrame, changes: DataFrame, id_col: str = "object_id") -> DataFrame:
    """docs after changes (seq, action, id, fields...): addObject and updateObject replace a document,
    partialUpdateObject sets the fields that are not null and creates a missing one, partialUpdateObjectNoCreate
    does not create it, deleteObject removes it, clear removes everything before it."""
    fields = [c for c in docs.columns if c != id_col]
    row = F.struct(*[F.col(f) if f in changes.columns else F.lit(None).cast(docs.schema[f].dataType).alias(f) for f in fields])
    cleared = changes.where("action IN ('clear', 'delete')").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("cleared"))
    steps = changes.where(F.col(id_col).isNotNull()).select(id_col, "seq", "action", row.alias("row"))
    base = docs.select(id_col, F.lit(-1).cast("long").alias("seq"), F.lit("base").alias("action"), F.struct(*fields).alias("row"))
    live = base.unionByName(steps).join(F.broadcast(cleared)).where(F.col("seq") > F.when(F.col("cleared") >= 0,
        F.col("cleared")).otherwise(-2))
    # what counts for an object begins with its last full replacement or removal; only sums of changes are kept
    whole = F.col("action").isin("base", "addObject", "updateObject", "deleteObject")
    last = live.where(whole).groupBy(id_col).agg(F.max("seq").alias("from"), F.max_by("action", "seq").alias("from_action"))
    after = live.join(last, id_col, "left").where((F.col("seq") >= F.coalesce("from", "seq")) & (F.col("action") != "deleteObject"))
    stands = F.coalesce(F.col("from_action") != "deleteObject", F.lit(False))
    # without an object to change, it begins with the first change that creates one
    born = after.where(~stands & (F.col("action") == "partialUpdateObject")).groupBy(id_col).agg(F.min("seq").alias("born"))
    counted = after.join(born, id_col, "left").where(stands | (F.col("seq") >= F.col("born")))
    newest = [F.max_by(F.col("row")[f], F.when(F.col("row")[f].isNotNull(), F.col("seq"))).alias(f) for f in fields]
    return counted.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"), *newest).drop("_n")


def partial_update(current: Column, operation: str, value: Column) -> Column:
    """A built-in operation on a field: Increment, Decrement, Add, Remove, AddUnique, IncrementFrom (only from
    its value), IncrementSet (only to a larger value)."""
    number, empty = F.coalesce(current, F.lit(0)) if operation.startswith(("In", "De")) else None, F.array().cast("array<string>")
    return {
        "Increment": lambda: number + value,
        "Decrement": lambda: number - value,
        "IncrementFrom": lambda: F.when(number == value, number + 1).otherwise(current),
        "IncrementSet": lambda: F.when(current.isNull() | (value > current), value).otherwise(current),
        "Add": lambda: F.array_append(F.coalesce(current, empty), value),
        "AddUnique": lambda: F.array_union(F.coalesce(current, empty), F.array(value)),
        "Remove": lambda: F.filter(current, lambda x: x != value),
    }[operation]()


def too_large(docs: DataFrame, most: int = MAX_DOCUMENT_BYTES) -> Column:
    """Whether a document's JSON exceeds the limit of a record."""
    return F.octet_length(F.to_json(F.struct(*docs.columns))) > most


def expired(day: Column, today: str, days: int = 90) -> Column:
    return day < F.date_sub(F.lit(today).cast("date"), days)


def enforce_retention(spark: SparkSession, root: str, today: dt.date, days: int = 90) -> int:
    """Delete date=YYYY-MM-DD folders of <root>/<index>/<kind> that are older; other names stay. Returns the number."""
    limit, removed = today - dt.timedelta(days=days), 0
    for index, _ in list_dir(spark, root):
        for kind, _ in list_dir(spark, f"{root}/{index}"):
            for name, _ in list_dir(spark, f"{root}/{index}/{kind}"):
                m = DAY_DIR.fullmatch(name)
                try:
                    old = m is not None and dt.date.fromisoformat(m[1]) < limit
                except ValueError:
                    continue
                if old:
                    delete(spark, f"{root}/{index}/{kind}/{name}")
                    removed += 1
    return removed


def snapshot_key(index: str, at: dt.datetime) -> str:
    return f"snapshots/{index}/{at.strftime('%Y%m%dT%H%M%SZ')}.tar.gz"


def keep_latest(keys: DataFrame, keep: int) -> DataFrame:
    """Snapshot keys (index_name, key) with whether retention keeps them; keys sort by time."""
    w = Window.partitionBy("index_name").orderBy(F.desc("key"))
    return keys.withColumn("kept", F.row_number().over(w) <= keep)


class Snapshots:
    """Snapshots of indexes in a folder of any store, by keys that sort by time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def put(self, index: str, data: bytes, at: dt.datetime) -> str:
        key = snapshot_key(index, at)
        out = _fs(self.spark, self.root).create(_path(self.spark, f"{self.root}/{key}"))
        out.write(bytearray(data))
        out.close()
        return key

    def list(self, index: str) -> list[str]:
        """Keys of an index, oldest first."""
        return [f"snapshots/{index}/{n}" for n, _ in list_dir(self.spark, f"{self.root}/snapshots/{index}") if n.endswith(".tar.gz")]

    def latest(self, index: str) -> str | None:
        return max(self.list(index), default=None)

    def get(self, key: str) -> bytes:
        return bytes(self.spark.read.format("binaryFile").load(f"{self.root}/{key}").first()["content"])

    def enforce_retention(self, index: str, keep: int) -> int:
        """Delete all but the newest `keep`; returns how many went."""
        old = self.list(index)[: -keep or None]
        for key in old:
            delete(self.spark, f"{self.root}/{key}")
        return len(old)


def since(log: DataFrame, seq: int) -> DataFrame:
    """Entries of a change log after a peer's acknowledged number."""
    return log.where(F.col("seq") > seq)


class Cursors:
    """The number that each peer has acknowledged: a file a peer and number, so that a lost write loses no other."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def acknowledge(self, peer: str, seq: int) -> None:
        _fs(self.spark, self.root).createNewFile(_path(self.spark, f"{self.root}/{peer}/{seq}"))

    def acknowledged(self, peer: str) -> int:
        """The largest number; 0 for a peer that has none."""
        return max((int(n) for n, _ in list_dir(self.spark, f"{self.root}/{peer}")), default=0)

    def pending(self, log: DataFrame, peer: str) -> DataFrame:
        return since(log, self.acknowledged(peer))

    def settled(self, peers: Sequence[str]) -> int:
        """The number up to which every peer has all entries, so that the log may forget them."""
        return min((self.acknowledged(p) for p in peers), default=0)


def seed_searches(spark: SparkSession, index: str, days: int, per_day: int, today: str) -> DataFrame:
    """A deterministic search log for demonstrations."""
    n = F.col("id")
    h = lambda a, b, most: (n * a + b) % most
    words = F.array(*map(F.lit, ["laptop", "phone", "red shoes", "camera", "desk", "lamp", "zzz"]))
    start, word = F.unix_millis(F.lit(today).cast("timestamp")), h(104_729, 71, 7)
    return spark.range(days * per_day).select(
        (start - (n % days + 1) * 86_400_000 + h(7919, 13, 1000) * 86_400).alias("timestamp_ms"), F.element_at(words,
            (word + 1).cast("int")).alias("query"), F.md5(n.cast("string")).alias("query_id"),
        F.lit(index).alias("index_name"), F.when(word == 6, 0).otherwise(h(1_299_709, 5, 40) + 1).alias("nb_hits"), (
            word != 6).alias("has_results"), h(15_485_863, 3, 1000).cast("string").alias("user_token"),
    )


def write_partitioned(rows: DataFrame, root: str) -> None:
    """The analytics layout: one folder an index and day, compressed with zstd."""
    rows.withColumn("date", F.to_date(F.timestamp_millis("timestamp_ms"))).write.mode("append").option("compression",
        "zstd").partitionBy("index_name", "date").parquet(root)


def flush(rows: DataFrame, root: str, disabled: bool = False) -> dict:
    """Write what is buffered; nothing where analytics are off."""
    if disabled:
        return {"status": "disabled"}
    write_partitioned(rows, root)
    return {"status": "ok"}


def clear_analytics(spark: SparkSession, root: str, index: str) -> int:
    """Remove the partitions of an index; returns their number."""
    top = f"{root.rstrip('/')}/index_name={index}"
    days = [n for n, _ in list_dir(spark, top) if DAY_DIR.fullmatch(n)]
    delete(spark, top)
    return len(days)
