"""Command line: python -m affinis.cli MODE FOLDER ...; a thin form of the verbs in affinis.plans.api."""

from __future__ import annotations

import argparse
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import api
from .sources.readers import id_list, sdf_records


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="affinis", description=__doc__)
    p.add_argument("mode", choices=["init", "build", "query", "embed", "add", "accuracy", "indexed", "cluster", "clean"])
    p.add_argument("folder", help="of the database")
    p.add_argument("-i", "--input", help="an SDF file; for query also one with --ids")
    p.add_argument("--ids", action="store_true", help="the input is a list of compound ids")
    p.add_argument("-x", "--references", help="a list of compound ids")
    p.add_argument("-m", "--measure", default="ap", help="the type of descriptor")
    p.add_argument("-k", type=int, default=10)
    p.add_argument("--shared", type=int, default=3, help="neighbours that two of a cluster share")
    p.add_argument("--cutoff", type=float)
    p.add_argument("-o", "--output", help="a folder for the result; else it is shown")
    p.add_argument("-s", "--set", action="append", default=[], metavar="NAME=VALUE", help=f"a setting: {', '.join(f.name for f in fields(api.Config))}")
    p.add_argument("--dry-run", action="store_true", help="show the plan of the result alone")
    return p


def _config(args: argparse.Namespace) -> api.Config:
    kinds = {f.name: type(f.default) for f in fields(api.Config)}
    pairs = (s.split("=", 1) for s in args.set)
    return api.Config(**({"descriptor_type": args.measure} | {k: kinds[k](v) for k, v in pairs}))


def _records(spark: SparkSession, path: str, first: int = 1) -> DataFrame:
    """Compound ids follow the records' order in the files."""
    from .operators.numbering import positions

    rows = positions(sdf_records(spark, path).withColumn("at", F.monotonically_increasing_id()), "at")
    return rows.select((F.col("pos") + first).alias("compound_id"), "sdf")


def run(args: argparse.Namespace, spark: SparkSession) -> DataFrame | None:
    if args.mode == "init":
        api.save(api.init_db(_records(spark, args.input), "sdf", _config(args)), args.folder)
        return None
    if args.mode == "clean":  # what build made
        path = spark._jvm.org.apache.hadoop.fs.Path
        for part in ("vectors", "index"):
            at = path(args.folder, part)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        api.save_settings(replace(api.load(spark, args.folder, embedded=False), references=[]), args.folder)
        return None
    db = api.load(spark, args.folder)
    if args.mode == "build":
        refs = id_list(spark, args.references) if args.references else None
        made = api.build_embedding(db, refs)
        made.vectors.write.mode("overwrite").parquet(f"{args.folder}/vectors")
        made.index.write.mode("overwrite").parquet(f"{args.folder}/index")
        api.save_settings(made, args.folder)
        return None
    if args.mode == "add":
        last = db.compounds.agg(F.max("compound_id")).first()[0] or 0
        more = api.add(db, _records(spark, args.input, last + 1), "sdf")
        new = lambda df, key: df.where(F.col(key) > last)
        new(more.compounds, "compound_id").write.mode("append").parquet(f"{args.folder}/compounds")
        new(more.vectors, "id").write.mode("append").parquet(f"{args.folder}/vectors")
        new(more.index, "id").write.mode("append").parquet(f"{args.folder}/index")
        return None
    if args.mode == "cluster":
        return api.cluster(db, args.k, args.shared, args.cutoff)
    if args.mode in ("accuracy", "indexed"):
        return api.evaluate(db, 100, args.k)[args.mode == "indexed"]
    rows, fmt = (id_list(spark, args.input), "compound_id") if args.ids else (_records(spark, args.input), "sdf")
    if args.mode == "embed":
        described = api.select_descriptors(db, rows) if args.ids else api.get_transform(db.config.descriptor_type, fmt).make(rows)
        return api.embed_rows(db, described)
    return api.query(db, rows, fmt, args.k, args.cutoff)


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("affinis").getOrCreate()
    out = run(args, spark)
    if out is None:
        return
    if args.dry_run:
        out.explain("formatted")
    elif args.output:
        out.write.mode("overwrite").parquet(args.output)
    else:
        out.show(100, truncate=False)


if __name__ == "__main__":
    main()
