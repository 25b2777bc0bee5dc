"""The engine's verbs: init_db, build_embedding, query, add, evaluate, cluster; and transforms that turn inputs into descriptors."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chemistry import compound_name, descriptor_from_string, descriptor_to_string, descriptors, fold_fingerprint, parse_sdf
from ..functions.measures import default_distance
from ..operators import clustering, evaluation, lsh_index, sets
from ..operators.embedding import MAX_REFERENCES, classical_scaling, distances_to_references, embed, reference_matrix
from ..operators.search import knn, refine
from .lineage import bounded, materialise

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Config:
    """Settings of a database; nothing is ever executed to read them."""

    descriptor_type: str = "ap"
    n_references: int = 300
    dim: int = 100
    width: float = 1.39564
    projections: int = 19
    tables: int = 10
    probes: int = 30
    widen: int = 2
    seed: int = 0


@dataclass(frozen=True)
class Transform:
    """make: (compound_id, input columns) -> (compound_id, name, descriptor); write and read: descriptor <-> text."""

    make: Step | None
    write: Callable[[Column], Column]
    read: Callable[[Column], Column]


_TRANSFORMS: dict[tuple[str, str | None], Transform] = {}


def add_transform(descriptor_type: str, fmt: str | None, make: Step | None, write: Callable[[Column], Column] | None = None, read: Callable[[Column], Column] | None = None) -> None:
    """Register how a format becomes a descriptor. Without a format, write and read must be given, and serve all formats of the type."""
    kind, fmt = descriptor_type.lower(), fmt.lower() if fmt else None
    if fmt is None and (write is None or read is None):
        raise ValueError("a type without a format needs both directions of its text form")
    base = _TRANSFORMS.get((kind, None))
    if write is None or read is None:
        if base is None:
            raise ValueError(f"{descriptor_type!r} has no text form yet")
        write, read = write or base.write, read or base.read
    _TRANSFORMS[(kind, fmt)] = Transform(make, write, read)


def get_transform(descriptor_type: str, fmt: str | None = None) -> Transform:
    try:
        return _TRANSFORMS[(descriptor_type.lower(), fmt.lower() if fmt else None)]
    except KeyError:
        raise ValueError(f"no transform of {descriptor_type!r} from {fmt!r}") from None


def _sdf_to_ap(rows: DataFrame) -> DataFrame:
    good = parse_sdf(rows, "sdf").where("valid")
    made = descriptors(good, "compound_id").withColumnRenamed("desc", "descriptor")
    return good.select("compound_id", compound_name(F.col("sdf")).alias("name")).join(made, "compound_id")


add_transform("ap", None, None, descriptor_to_string, descriptor_from_string)
add_transform("ap", "sdf", _sdf_to_ap)
add_transform("fp", None, None, descriptor_to_string, descriptor_from_string)
add_transform("fp", "sdf", lambda rows: _sdf_to_ap(rows).withColumn("descriptor", fold_fingerprint(F.col("descriptor"))))
add_transform("vector", None, None, lambda c: F.array_join(c.cast("array<string>"), ","), lambda c: F.split(c, ",").cast("array<double>"))
add_transform("vector", "vector", lambda rows: rows.select("compound_id", F.col("compound_id").cast("string").alias("name"), F.col("vector").cast("array<double>").alias("descriptor")))


@dataclass
class Database:
    """compounds: compound_id, name, descriptor. vectors: id, vec. index: tbl, bucket, id."""

    compounds: DataFrame
    config: Config
    references: list[int] = field(default_factory=list)
    coordinates: np.ndarray | None = None
    vectors: DataFrame | None = None
    index: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.compounds.sparkSession

    @property
    def params(self) -> lsh_index.LshParams:
        c = self.config
        return lsh_index.LshParams.random(self.coordinates.shape[1], c.tables, c.projections, c.width, seed=c.seed)


def init_db(rows: DataFrame, fmt: str, config: Config = Config()) -> Database:  # noqa: B008
    """Describe the inputs (compound_id and the format's columns); what cannot be described is left out."""
    make = get_transform(config.descriptor_type, fmt).make
    return Database(materialise(make(rows), "compounds"), config)


def select_descriptors(db: Database, ids: DataFrame) -> DataFrame:
    """pos, compound_id, name, descriptor of the requested ids (compound_id, pos); an unknown id is an error."""
    sets.assert_subset(ids, db.compounds, "compound_id")
    return ids.join(db.compounds, "compound_id")


def by_name(db: Database, names: DataFrame) -> DataFrame:
    """names with compound_id, null if there is no such name."""
    return sets.lookup(names, db.compounds.select("name", "compound_id"), "name")


def _pairs_to(rows: DataFrame, refs: DataFrame, distance: Callable[[Column, Column], Column]) -> DataFrame:
    """query_id, target_id, dist of every row to every reference; the references are a bounded set (see reference_matrix)."""
    r = bounded(refs.select(F.col("compound_id").alias("target_id"), F.col("descriptor").alias("__r")), MAX_REFERENCES, "references")
    return rows.crossJoin(r).select(F.col("compound_id").alias("query_id"), "target_id", distance(F.col("descriptor"), F.col("__r")).alias("dist"))


def build_embedding(db: Database, references: DataFrame | list[int] | None = None) -> Database:
    """Choose references (a table or list of ids; else a seeded sample), scale them, embed all compounds and index them."""
    c, spark = db.config, db.spark
    distance = default_distance(c.descriptor_type)
    if references is None:
        refs = sets.sample(db.compounds, c.n_references, "compound_id", c.seed)
    else:
        ids = references if isinstance(references, DataFrame) else spark.createDataFrame([(i,) for i in references], "compound_id long")
        refs = sets.select_rows(db.compounds, ids, "compound_id", all_found=True)
    refs = materialise(refs, "references")
    square = _pairs_to(refs, refs, distance).select(F.col("query_id").alias("left_id"), F.col("target_id").alias("right_id"), "dist")
    ids, d = reference_matrix(square)
    made = Database(db.compounds, c, ids, classical_scaling(d, c.dim))
    made.vectors = materialise(embed_rows(made, db.compounds), "vectors")
    made.index = materialise(lsh_index.build_index(made.vectors, made.params), "index")
    return made


def embed_rows(db: Database, rows: DataFrame) -> DataFrame:
    """id, vec of described rows, by their distances to the references."""
    refs = db.compounds.where(F.col("compound_id").isin(db.references))
    dists = distances_to_references(_pairs_to(rows, refs, default_distance(db.config.descriptor_type)), db.references)
    return embed(dists, db.coordinates)


def query(db: Database, rows: DataFrame, fmt: str, k: int, cutoff: float | None = None) -> DataFrame:
    """query, target, distance, target_ids, rank: the k nearest by the descriptor's distance among candidates of the index.

    fmt: compound_id or name (of stored compounds; unknown ones are an error), or a format with a transform.
    """
    c = db.config
    if fmt in ("compound_id", "name"):
        ids = by_name(db, rows) if fmt == "name" else rows
        described = select_descriptors(db, ids.select("compound_id"))
    else:
        described = get_transform(c.descriptor_type, fmt).make(rows)
    described = materialise(described.select("compound_id", "name", "descriptor"), "queries")
    vectors = embed_rows(db, described)
    near = lsh_index.search(vectors, db.vectors, db.params, k * c.widen, c.probes, db.index)
    best = refine(near, described, db.compounds, default_distance(c.descriptor_type), k, cutoff, key="compound_id", value="descriptor")
    q = described.select(F.col("compound_id").alias("query_id"), F.col("name").alias("query"))
    t = db.compounds.select(F.col("compound_id").alias("target_id"), F.col("name").alias("target"))
    return best.join(q, "query_id").join(t, "target_id").select("query", "target", F.col("dist").alias("distance"), F.col("target_id").alias("target_ids"), "rank")


def add(db: Database, rows: DataFrame, fmt: str) -> Database:
    """Describe, embed and index new compounds; references and what is stored stay as they are."""
    new = materialise(get_transform(db.config.descriptor_type, fmt).make(rows), "additions")
    vectors = materialise(embed_rows(db, new), "vectors")
    index = materialise(lsh_index.build_index(vectors, db.params), "index")
    return replace(
        db, compounds=db.compounds.unionByName(new.select(db.compounds.columns)), vectors=db.vectors.unionByName(vectors), index=db.index.unionByName(index)
    )


def evaluate(db: Database, n_queries: int, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """The recall curve of exact search in the embedding, and the recall of each query by the index, against true distances."""
    queries = materialise(sets.sample(db.compounds.where(~F.col("compound_id").isin(db.references)), n_queries, "compound_id", db.config.seed + 1), "test-queries")
    from ..operators.search import top_k

    truth = materialise(top_k(_pairs_to(db.compounds, queries, default_distance(db.config.descriptor_type)).select(F.col("target_id").alias("query_id"), F.col("query_id").alias("target_id"), "dist"), 50_000), "truth")
    vectors = embed_rows(db, queries)
    euclidean = knn(vectors, db.vectors, 50_000)
    near = lsh_index.search(vectors, db.vectors, db.params, k * db.config.widen, db.config.probes, db.index)
    indexed = refine(near, queries, db.compounds, default_distance(db.config.descriptor_type), k, key="compound_id", value="descriptor")
    return evaluation.recall_curve(truth, euclidean), evaluation.compare_search(truth, indexed, k)


def cluster(db: Database, k: int, min_shared: int, cutoff: float | None = None, matrix_only: bool = False, mutual: bool = True) -> DataFrame:
    """Clusters by shared neighbours among the k nearest of the index, itself included; matrix_only: the neighbour lists."""
    c = db.config
    near = lsh_index.search(db.vectors, db.vectors, db.params, 2 * k, c.probes, db.index)
    best = refine(near, db.compounds, db.compounds, default_distance(c.descriptor_type), k, cutoff, key="compound_id", value="descriptor")
    lists = materialise(clustering.neighbour_lists(best), "neighbours")
    return lists if matrix_only else clustering.jarvis_patrick(lists, min_shared, mutual)


def save_settings(db: Database, path: str) -> None:
    """One row: settings, references and coordinates."""
    at = [] if db.coordinates is None else db.coordinates.tolist()
    row = db.spark.createDataFrame([(json.dumps(asdict(db.config)), db.references, at)], "config string, refs array<long>, coordinates array<array<double>>")
    row.write.mode("overwrite").parquet(f"{path}/settings")


def save(db: Database, path: str) -> None:
    """Write a database to a folder that it was not read from."""
    db.compounds.write.mode("overwrite").parquet(f"{path}/compounds")
    if db.vectors is not None:
        db.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        db.index.write.mode("overwrite").parquet(f"{path}/index")
    save_settings(db, path)


def load(spark: SparkSession, path: str, embedded: bool = True) -> Database:
    """embedded=False: without what build_embedding has made."""
    r = spark.read.parquet(f"{path}/settings").first()
    db = Database(spark.read.parquet(f"{path}/compounds"), Config(**json.loads(r["config"])), list(r["refs"]))
    if embedded and r["coordinates"]:
        db.coordinates = np.array(r["coordinates"])
        db.vectors, db.index = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/index")
    return db
