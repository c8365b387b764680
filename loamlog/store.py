"""EntityStore: collections of entities on Parquet, with atomic commits.

A commit writes its records as Parquet, then a marker commits/N.json by an atomic rename that fails if the marker
exists; readers see the records of marked commits alone. So a commit is seen whole or not at all, a lost driver leaves
nothing but unread files, and of two writers that race for one number one fails and can try again. A compaction is one
file too, compactions/N.json, which stands for all commits up to N; metadata has numbered versions, the newest counts.
"""

from __future__ import annotations

import time
from collections import Counter
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.tokens import Tokenizer
from .operators import access, conflicts, inspect, log, search
from .sources.files import Files, read_backup, valid_backup, write_backup
from .streaming import feed

#: The collection that holds the store's own entries; they are in no feed.
METADATA = 0
RECORDS = "collection_id long, entity_id string, sequence long, is_tombstone boolean, change_type string, payload string"


class ConflictError(Exception):
    """What a transaction read isn't there any more."""


class ScanForbidden(Exception):
    """A full scan of a collection whose policy forbids it."""


class Transaction:
    """Writes that become one commit. Reads see the store as it was at the begin, under the writes."""

    def __init__(self, store: EntityStore):
        self.store, self.snapshot = store, store.committed_sequence
        self._writes: dict[tuple[int, str], str | None] = {}
        self._reads: dict[tuple[int, str], str | None] = {}
        self._frames: list[DataFrame] = []

    def put(self, collection: str, entity_id: str, payload: str) -> None:
        self._writes[self.store.collection_id(collection), entity_id] = payload

    def delete(self, collection: str, entity_id: str) -> None:
        """Removes an entity; one that never was gets a tombstone too."""
        self._writes[self.store.collection_id(collection), entity_id] = None

    def put_frame(self, collection: str, rows: DataFrame) -> None:
        """Many writes: entity_id, payload (null removes). Of repeated ids one of the payloads counts."""
        cid = self.store.collection_id(collection)
        one = rows.groupBy(F.col("entity_id").cast("string").alias("entity_id")).agg(F.max("payload").alias("payload"))
        self._frames.append(one.withColumn("collection_id", F.lit(cid).cast("long")))

    def get(self, collection: str, entity_id: str) -> str | None:
        key = (self.store.collection_id(collection), entity_id)
        if key in self._writes:
            return self._writes[key]
        row = log.scan(self.store.log(collection).filter(F.col("entity_id") == entity_id), self.snapshot).first()
        payload = row["payload"] if row else None
        self._reads.setdefault(key, payload)
        return payload

    def _staged(self) -> DataFrame:
        rows = [(c, e, p) for (c, e), p in self._writes.items()]
        staged = self.store.spark.createDataFrame(rows, "collection_id long, entity_id string, payload string")
        for frame in self._frames:
            mine = staged.select("collection_id", "entity_id")
            rest = frame.join(mine, ["collection_id", "entity_id"], "left_anti")
            staged = staged.unionByName(rest)
        return staged

    def commit(self) -> int:
        return self.store._commit(self)


class EntityStore:
    """Collections of entities (id, payload) at a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, scan_policy: str = "allow"):
        if scan_policy not in ("allow", "warn", "forbid"):
            raise ValueError("scan_policy: allow, warn or forbid")
        self.spark, self.path, self.scan_policy = spark, path.rstrip("/"), scan_policy
        self.files = Files(spark, path)
        self.stats: Counter[str] = Counter()
        self._indexes: dict[tuple[int, str, str], bool] = {}
        self._search: dict[tuple[int, str], Tokenizer] = {}
        if not self.files.names("manifest"):
            self.files.write("manifest/0.json", {"collections": {}, "indexes": [], "schema_version": 0})
        for c, f, kind, unique in self._manifest()["indexes"]:
            self._indexes[c, f, kind] = unique

    # Metadata

    def _manifest(self) -> dict:
        return self.files.read(f"manifest/{self._newest('manifest')}.json")

    def _set(self, **changes) -> None:
        """A new version; an error if another writer was first. Older ones are removed."""
        last = self._newest("manifest")
        self.files.write(f"manifest/{last + 1}.json", self._manifest() | changes)
        for n in self._numbers("manifest"):
            if n <= last:
                self.files.delete(f"manifest/{n}.json")

    def _numbers(self, folder: str) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(folder) if n.endswith(".json"))

    def _newest(self, folder: str) -> int:
        return max(self._numbers(folder), default=0)

    def create_collection(self, name: str) -> int:
        """The collection's id; a new one if there is none of this name."""
        held = self._manifest()["collections"]
        if name not in held:
            held[name] = max(held.values(), default=METADATA) + 1
            self._set(collections=held)
        return held[name]

    def get_collection(self, name: str) -> int | None:
        return self._manifest()["collections"].get(name)

    def collection_id(self, name: str) -> int:
        found = self.get_collection(name)
        if found is None:
            raise KeyError(name)
        return found

    def collections(self) -> dict[str, int]:
        return self._manifest()["collections"]

    @property
    def schema_version(self) -> int:
        return self._manifest()["schema_version"]

    def set_schema_version(self, version: int) -> None:
        self._set(schema_version=version)

    @property
    def commits(self) -> list[int]:
        """Those that no compaction stands for."""
        last = self._newest("compactions")
        return [n for n in self._numbers("commits") if n > last]

    @property
    def committed_sequence(self) -> int:
        return max(self.commits, default=self._newest("compactions"))

    # Reading

    def records(self) -> DataFrame:
        """All versions of marked commits: one file listing, and a partition filter."""
        last = self._newest("compactions")
        markers = [f"compactions/{last}.json"] * bool(last) + [f"commits/{n}.json" for n in self.commits]
        parts = [f"{self.path}/{self.files.read(m)['records']}" for m in markers]
        if not parts:
            return self.spark.createDataFrame([], RECORDS)
        return self.spark.read.schema(RECORDS).parquet(*dict.fromkeys(parts))

    def log(self, collection: str) -> DataFrame:
        return self.records().filter(F.col("collection_id") == self.collection_id(collection))

    def scan(self, collection: str, as_of: int | None = None) -> DataFrame:
        """Entities that exist, now or after a commit."""
        if self.scan_policy == "forbid":
            raise ScanForbidden(collection)
        if self.scan_policy == "warn":
            self.stats["scan_warnings"] += 1
        self.stats["scans"] += 1
        return log.scan(self.log(collection), as_of).select("entity_id", "payload", "sequence")

    def get(self, collection: str, entity_id: str, as_of: int | None = None) -> str | None:
        row = self.get_many(collection, [entity_id], as_of).first()
        return row["payload"] if row else None

    def get_many(self, collection: str, ids: list[str], as_of: int | None = None) -> DataFrame:
        self.stats["reads"] += len(ids)
        return log.get(self.log(collection), ids, as_of).select("entity_id", "payload", "sequence")

    def exists(self, collection: str, entity_id: str) -> bool:
        return self.get(collection, entity_id) is not None

    def count(self, collection: str) -> int:
        return log.scan(self.log(collection)).count()

    def entity_count(self) -> int:
        """Entities that ever were, removed ones too."""
        return self.records().select("collection_id", "entity_id").distinct().count()

    def iterate(self, collection: str, as_of: int | None = None):
        """Entities one by one, partition after partition, without holding all of them."""
        return self.scan(collection, as_of).toLocalIterator()

    def scan_with_limit(self, collection: str, n: int) -> DataFrame:
        """Some n entities; bounded, so no policy forbids it."""
        return log.scan(self.log(collection)).select("entity_id", "payload", "sequence").limit(n)

    def commit_records(self, number: int) -> DataFrame:
        """What one commit wrote."""
        marker = f"commits/{number}.json"
        place = self.files.read(marker if self.files.exists(marker) else f"compactions/{number}.json")["records"]
        return self.spark.read.schema(RECORDS).parquet(f"{self.path}/{place}")

    def history(self, collection: str, entity_id: str) -> DataFrame:
        return log.history(self.log(collection), entity_id)

    # Writing

    def begin(self) -> Transaction:
        self.stats["transactions_started"] += 1
        return Transaction(self)

    @contextmanager
    def transaction(self):
        """Commits at the end, unless an error leaves it."""
        t = self.begin()
        try:
            yield t
        except BaseException:
            self.stats["transactions_aborted"] += 1
            raise
        t.commit()

    def put(self, collection: str, entity_id: str, payload: str) -> int:
        with self.transaction() as t:
            t.put(collection, entity_id, payload)
        return self.committed_sequence

    def delete(self, collection: str, entity_id: str) -> int:
        with self.transaction() as t:
            t.delete(collection, entity_id)
        return self.committed_sequence

    def _check(self, t: Transaction) -> None:
        """Against all commits there are; a later one takes the number that this one is about to take."""
        read = [(c, e, p) for (c, e), p in t._reads.items() if (c, e) in t._writes]
        if not read:
            return
        seen = self.spark.createDataFrame(read, "collection_id long, entity_id string, _seen string")
        keys = ["collection_id", "entity_id"]
        now = log.scan(self.records().join(F.broadcast(seen.select(*keys)), keys, "left_semi")).select(*keys, "payload")
        bad = seen.join(now, keys, "left").filter(~F.col("_seen").eqNullSafe(F.col("payload"))).first()
        if bad:
            self.stats["transactions_aborted"] += 1
            raise ConflictError(f"{bad[0]}/{bad[1]}")

    def _commit(self, t: Transaction) -> int:
        number = self.committed_sequence + 1
        self._check(t)
        staged = t._staged()
        before = log.latest(self.records()).select(
            "collection_id", "entity_id", F.col("is_tombstone").alias("_gone")
        )
        new = staged.join(before, ["collection_id", "entity_id"], "left").select(
            "collection_id", "entity_id", F.lit(number).cast("long").alias("sequence"),
            F.col("payload").isNull().alias("is_tombstone"),
            F.when(F.col("payload").isNull(), "delete").when(F.coalesce("_gone", F.lit(True)), "insert")
            .otherwise("update").alias("change_type"),
            "payload",
        )
        place = f"records/commit={number}-{time.time_ns()}"
        new.write.parquet(f"{self.path}/{place}")
        self._check_unique(self.spark.read.schema(RECORDS).parquet(f"{self.path}/{place}"))
        self.files.write(f"commits/{number}.json", {"records": place})
        self.stats["transactions_committed"] += 1
        self.stats["writes"] += len(t._writes)
        return number

    def _check_unique(self, new: DataFrame) -> None:
        for (cid, field, _), unique in self._indexes.items():
            if unique:
                rows = log.scan(self.records().unionByName(new).filter(F.col("collection_id") == cid))
                if access.unique_violations(self._keys(rows, field), "key", "entity_id").limit(1).count():
                    raise ConflictError(f"{field} isn't unique")

    # Indexes

    def create_index(self, collection: str, field: str, kind: str = "hash", unique: bool = False) -> None:
        """A view of a field of JSON payloads by key. Unique ones are enforced before a commit."""
        if kind not in ("hash", "btree"):
            raise ValueError(kind)
        self._indexes[self.collection_id(collection), field, kind] = unique
        self._set(indexes=[[*k, u] for k, u in self._indexes.items()])

    def drop_index(self, collection: str, field: str, kind: str) -> bool:
        found = self._indexes.pop((self.collection_id(collection), field, kind), None) is not None
        self._set(indexes=[[*k, u] for k, u in self._indexes.items()])
        return found

    @staticmethod
    def _keys(rows: DataFrame, field: str) -> DataFrame:
        """Keys of entities; an entity without the field has none, an explicit null has a null."""
        value = F.try_parse_json("payload")
        path = f"$.{field}"
        held = F.variant_get(value, path, "variant")
        return rows.filter(held.isNotNull()).select(F.try_variant_get(value, path, "string").alias("key"), "entity_id")

    def _index(self, collection: str, field: str, *kinds: str) -> DataFrame:
        cid = self.collection_id(collection)
        if not any((cid, field, k) in self._indexes for k in kinds):
            raise KeyError(f"no index on {field}")
        self.stats["index_lookups"] += 1
        return self._keys(log.scan(self.log(collection)), field)

    def lookup(self, collection: str, field: str, key: str | None) -> DataFrame:
        return access.equal(self._index(collection, field, "hash", "btree"), "key", key).select("entity_id")

    def lookup_range(self, collection: str, field: str, least=None, most=None, kind: str = "string") -> DataFrame:
        """Entities whose key is in an inclusive range, in order; kind is the type that keys compare as."""
        keys = self._index(collection, field, "btree").withColumn("key", F.col("key").try_cast(kind))
        return access.between(keys, "key", least, most).orderBy("key", "entity_id")

    # Full-text search

    def create_search_index(self, collection: str, field: str, tokenizer: Tokenizer | None = None) -> None:
        key = (self.collection_id(collection), field)
        if key in self._search:
            raise ValueError("there is one")
        self._search[key] = tokenizer or Tokenizer()

    def drop_search_index(self, collection: str, field: str) -> bool:
        return self._search.pop((self.collection_id(collection), field), None) is not None

    def _postings(self, collection: str, field: str) -> tuple[DataFrame, Tokenizer]:
        tokenizer = self._search[self.collection_id(collection), field]
        rows = log.scan(self.log(collection)).select("entity_id", F.get_json_object("payload", f"$.{field}").alias("t"))
        return search.postings(rows, "entity_id", "t", tokenizer), tokenizer

    def search(self, collection: str, field: str, query: str) -> DataFrame:
        return search.search_all(*self._pair(collection, field, query))

    def search_any(self, collection: str, field: str, query: str) -> DataFrame:
        return search.search_any(*self._pair(collection, field, query))

    def search_prefix(self, collection: str, field: str, prefix: str) -> DataFrame:
        return search.search_prefix(*self._pair(collection, field, prefix))

    def _pair(self, collection: str, field: str, query: str):
        post, tokenizer = self._postings(collection, field)
        return post, query, tokenizer

    # Feed, compaction, backup, inspection

    def changes(self, cursor: int = 0, limit: int | None = None) -> DataFrame:
        """Changes after a commit, in order; with a limit, whole commits until it is reached."""
        rows = self.records().filter((F.col("sequence") > cursor) & (F.col("collection_id") != METADATA))
        if limit is not None:
            last = feed.poll(rows, cursor, limit).agg(F.max("sequence")).first()[0] or cursor
            rows = rows.filter(F.col("sequence") <= last)
        return rows.orderBy("sequence", "collection_id", "entity_id")

    def compact(self, keep_tombstones: bool = False) -> int:
        """Rewrites all commits as one with what is newest; snapshots before it can't be read any more."""
        number = self.committed_sequence
        if not number:
            return 0
        place = f"records/compacted={number}-{time.time_ns()}"
        log.compact(self.records(), keep_tombstones).write.parquet(f"{self.path}/{place}")
        self.files.write(f"compactions/{number}.json", {"records": place})
        for n in self._numbers("commits"):  # none of them is read any more
            if n <= number:
                self.files.delete(f"commits/{n}.json")
        self.stats["compactions"] += 1
        return number

    def backup(self, path: str, tombstones: bool = True) -> dict:
        return write_backup(log.backup_records(self.records(), self.committed_sequence, tombstones), path)

    def restore(self, path: str) -> int:
        """A backup's records as one new commit; entities that it doesn't have stay."""
        names = {v: k for k, v in self.collections().items()}
        held = read_backup(self.spark, path)
        t = self.begin()
        for row in held.select("collection_id").distinct().toLocalIterator():
            name = names.get(row[0]) or f"restored-{row[0]}"
            self.create_collection(name)
            t.put_frame(name, held.filter(F.col("collection_id") == row[0]).select("entity_id", "payload"))
        return t.commit()

    def valid_backup(self, path: str) -> bool:
        return valid_backup(self.spark, path)

    def inspect(self) -> DataFrame:
        return inspect.collections(self.records(), "collection_id", F.coalesce(F.octet_length("payload"), F.lit(0)))

    def snapshot_stats(self) -> dict[str, int]:
        """Counters of this object, and what the store holds."""
        held = inspect.counts(self.records()).first()
        return dict(self.stats) | {
            "commits": len(self.commits), "entity_count": held["chains"], "live_entities": held["live_entities"] or 0,
        }

    def payload_hashes(self, collection: str) -> DataFrame:
        return log.scan(self.log(collection)).select("entity_id", conflicts.content_hash("payload").alias("current_hash"))
