"""A table in buckets of its key: an upsert rewrites only the buckets that it touches.

Every version has a manifest, one line of JSON, that names the folder of each bucket. New folders are written first; a
version exists from the moment its manifest is renamed into place, so readers see whole versions and a run that fails
before leaves the old one as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.stage import stage
from tidemark.sources.tables import newest_per_key, upsert


class BucketTable:
    """Rows under `root` by a hash of `keys`, columns as in `schema`; keys are whole numbers, texts, dates or times."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str], buckets: int = 64):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.keys, self.buckets = list(keys), buckets

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        """Numbers of all versions, oldest first."""
        fs, path = self._fs("manifests")
        if not fs.exists(path):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(path))
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """Folder of each bucket that has rows; the newest version if none is given."""
        known = self.versions()
        if version is None and not known:
            return {}
        line = self.spark.read.text(f"{self.root}/manifests/{known[-1] if version is None else version:09d}").first()[0]
        return {int(b): folder for b, folder in json.loads(line).items()}

    def read(self, version: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """The rows of a version, of the buckets `only` if given."""
        held = self.manifest(version)
        paths = [f"{self.root}/data/{held[b]}/bucket={b}" for b in sorted(held) if only is None or b in set(only)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _write(self, rows: DataFrame, touched: Sequence[int]) -> dict[int, str]:
        folder = uuid.uuid4().hex
        dealt = rows.select(*self.schema.names, self._bucket().alias("bucket")).repartition(max(1, len(touched)), "bucket")
        dealt.write.partitionBy("bucket").parquet(f"{self.root}/data/{folder}")
        return dict.fromkeys(touched, folder)

    def _commit(self, held: dict[int, str], version: int) -> int:
        fs, draft = self._fs(f"manifests/_{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        _, final = self._fs(f"manifests/{version:09d}")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"version {version} of {self.root} was written by another run")
        return version

    def upsert(self, new: DataFrame, keep: Sequence[str] = ("id", "created_at"), newest: Sequence[str] = ()) -> int:
        """The next version, with `tables.upsert` of `new`; its number. Without rows in `new` the version stays as it is.

        `new` may lack columns: old values stay and new rows have null there. Rows of `new` with one key count as the last one in the order of
        the columns `newest`. Columns that the table does not have are left out. Of two runs at a time one fails.
        """
        known = self.versions()
        last = known[-1] if known else 0
        fields = [f for f in self.schema.fields if f.name in new.columns]
        cast = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
        order = [c for c in newest if c in cast.columns]
        fresh = stage(newest_per_key(cast, self.keys, order), "upsert")  # one row per key: no bucket is much larger than another
        touched = sorted(r[0] for r in fresh.select(self._bucket()).distinct().collect())  # at most `buckets`
        if not touched:
            return last
        held = self.manifest(last) if known else {}
        merged = upsert(self.read(last, touched) if known else self.spark.createDataFrame([], self.schema), fresh, self.keys, keep)
        return self._commit(held | self._write(merged, touched), last + 1)

    def expire(self, keep: int = 2) -> int:
        """Deletes all versions but the last `keep` and the folders that only they name; how many folders went.

        Not to be run beside an upsert, whose folders no manifest names yet.
        """
        known = self.versions()
        named = {folder for v in known[-keep:] for folder in self.manifest(v).values()}
        fs, data = self._fs("data")
        gone = 0
        for status in fs.listStatus(data) if fs.exists(data) else ():
            if status.getPath().getName() not in named:
                fs.delete(status.getPath(), True)
                gone += 1
        for v in known[:-keep]:
            fs.delete(self._fs(f"manifests/{v:09d}")[1], False)
        return gone
