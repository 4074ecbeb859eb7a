"""An alias index in generations: documents are indexed under one set of aliases while the index for the next set is built beside
it, page by page, and takes over by one row of a manifest.

Below one folder lie `raw` (documents as they came), `index` (each generation's documents: length and distinct canonical terms) and
`manifest`. A manifest row is the whole state; the newest one holds. Data are written first and named by a row afterwards,
so a step that is broken off leaves nothing to see, and when it is run again it writes the same place anew. Readers bind to one row:
a swap does not disturb a query that is under way. There must be one writer; readers may be any number.

A page is a number of whole files of `raw` in the order of their paths, which is stable as files never change once they are
named. So a build reads every file once and sorts nothing, and the cursor is a path.

Defined results: null tokens are an empty document; ids are unique, not null and larger than all before; a batch that was
already taken changes nothing; batches are numbered from 0 without gaps; other columns are dropped; a generation
on an empty corpus is active at once; asking for the active aliases ends a build; other aliases than those being built replace them.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offersieve.functions import text as X
from offersieve.operators import arrivals as A
from offersieve.operators.lineage import _delete

#: Fixed value: names the way tokens are made; another way makes all indexes stale.
NORMALIZATION = "search-terms-v2"
PAGE = 64
_RAW = "id long, tokens array<string>"
_INDEX = "id long, len long, terms array<string>, gen long, kind string, n long"


def _json(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def fingerprint(aliases: dict[str, list[str]]) -> str:
    """Digest of a set of aliases, whatever the order of its names, and of how tokens are made."""
    return hashlib.sha256(_json({"aliases": aliases, "normalization_version": NORMALIZATION}).encode()).hexdigest()


@dataclass(frozen=True)
class State:
    """One manifest row. Aliases are JSON; `building` is -1 where nothing is built. `steps` counts pages: of the active
    generation when it was built, and of the one being built. `since` is the last batch that the build reads as pages."""

    version: int = 0
    active: int = 0
    aliases: str = "{}"
    steps: int = 0
    building: int = -1
    next_aliases: str = ""
    next_steps: int = 0
    since: int = -1
    cursor: str = ""
    batch: int = -1
    last: int | None = None
    count: int = 0
    generations: int = 1


_MANIFEST = "version long, active long, aliases string, steps long, building long, next_aliases string, next_steps long, since long, cursor string, batch long, last long, count long, generations long"


class AliasIndex:
    def __init__(self, spark: SparkSession, root: str, page: int = PAGE) -> None:
        self.spark, self.root, self.page = spark, root.rstrip("/"), page
        if not self._exists("manifest"):
            self._commit(State())

    def _exists(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _commit(self, state: State) -> State:
        """One row in one file: it is there whole or not at all."""
        self.spark.createDataFrame([tuple(asdict(state).values())], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return state

    def _next(self, state: State, **changes) -> State:
        return self._commit(replace(state, version=state.version + 1, **changes))

    def state(self) -> State:
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest").orderBy(F.desc("version")).limit(1).collect()
        return State(**rows[0].asDict()) if rows else self._commit(State())

    def ready(self, aliases: dict[str, list[str]]) -> bool:
        return self.state().aliases == _json(aliases)

    def insert(self, docs: DataFrame, batch: int) -> int:
        """Documents (id, tokens) into the corpus, the active generation and the one being built; how many it now has.
        Fit for foreachBatch: a batch that comes again changes nothing."""
        s = self.state()
        if batch <= s.batch:
            return s.count
        if batch != s.batch + 1:
            raise ValueError(f"batch {batch} after {s.batch}")
        path = f"{self.root}/raw/batch={batch}"
        docs.select(F.col("id").cast("long").alias("id"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")).write.mode("overwrite").option("compression", "zstd").parquet(path)
        raw = self.spark.read.schema(_RAW).parquet(path)
        got = raw.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.min("id").alias("least"), F.max("id").alias("most")).first()
        if got["rows"] != got["ids"]:
            raise ValueError("ids must be unique and not null")
        if got["rows"] and s.last is not None and got["least"] <= s.last:
            raise ValueError(f"id {got['least']} is not larger than {s.last}")
        self._index(raw, s.active, s.aliases, "arrived", batch)
        if s.building >= 0:
            self._index(raw, s.building, s.next_aliases, "arrived", batch)
        return self._next(s, batch=batch, count=s.count + got["rows"], last=got["most"] if got["rows"] else s.last).count

    def _index(self, raw: DataFrame, gen: int, aliases: str, kind: str, n: int) -> None:
        canon = X.canonical_tokens(F.col("tokens"), X.alias_groups(json.loads(aliases)))
        rows = raw.select("id", canon.alias("canon")).select("id", F.size("canon").cast("long").alias("len"), F.array_distinct("canon").alias("terms"))
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/index/gen={gen}/kind={kind}/n={n}")

    def start(self, aliases: dict[str, list[str]]) -> bool:
        """Asks for an index under these aliases; whether it is the active one."""
        s, wanted = self.state(), _json(aliases)
        if wanted == s.aliases:
            if s.building >= 0:
                self._next(s, building=-1, next_aliases="", next_steps=0, cursor="")
            return True
        if s.building >= 0 and wanted == s.next_aliases:
            return False
        gen = s.generations
        if s.count == 0:
            self._next(s, active=gen, aliases=wanted, steps=0, generations=gen + 1, building=-1, next_aliases="", next_steps=0, cursor="")
            return True
        self._next(s, building=gen, next_aliases=wanted, next_steps=0, since=s.batch, cursor="", generations=gen + 1)
        return False

    def _pages(self, s: State) -> list[str]:
        """Files of the build after its cursor."""
        # batches are named one by one: a batch that was broken off may lie beside them
        paths = [f"{self.root}/raw/batch={n}" for n in range(s.since + 1)]
        return sorted(f for f in self.spark.read.schema(_RAW).parquet(*paths).inputFiles() if f > s.cursor)

    def build_page(self) -> bool:
        """Indexes the build's next page, and makes its generation the active one after the last; whether none is being built."""
        s = self.state()
        if s.building < 0:
            return True
        left = self._pages(s)
        if left:
            step = s.next_steps + 1
            self._index(self.spark.read.schema(_RAW).parquet(*left[: self.page]), s.building, s.next_aliases, "built", step)
            s = replace(s, next_steps=step, cursor=left[: self.page][-1])
        if len(left) > self.page:
            self._next(s)
            return False
        self._next(s, active=s.building, aliases=s.next_aliases, steps=s.next_steps, building=-1, next_aliases="", next_steps=0, cursor="")
        return True

    def build(self) -> None:
        while not self.build_page():
            pass

    def documents(self, limit: int | None = None) -> DataFrame:
        """id, len, terms of the active generation as of now: of all documents, or of the last `limit`."""
        s = self.state()
        if s.count == 0:
            return self.spark.createDataFrame([], _INDEX).select("id", "len", "terms")
        rows = self.spark.read.schema(_INDEX).parquet(f"{self.root}/index")
        named: Column = ((F.col("kind") == "arrived") & (F.col("n") <= s.batch)) | ((F.col("kind") == "built") & (F.col("n") <= s.steps))
        rows = rows.filter((F.col("gen") == s.active) & named).select("id", "len", "terms")
        if limit is None or limit >= s.count:
            return rows
        first = A.dense(rows.select("id"), "id").filter(F.col("seq") == s.count - limit).first() if limit > 0 else None
        return rows.filter(F.col("id") >= first["id"]) if first else rows.filter(F.lit(False))

    def statistics(self, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
        """One row of n and avgdl (0 documents: avgdl null), and term, df."""
        docs = self.documents(limit)
        df = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        return docs.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl")), df

    def vacuum(self) -> None:
        """Deletes generations that are neither active nor being built; call it when no reader holds an older state."""
        s = self.state()
        for gen in set(range(s.generations)) - {s.active, s.building}:
            _delete(self.spark, f"{self.root}/index/gen={gen}")
