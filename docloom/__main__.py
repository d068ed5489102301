"""Jobs from the command line: python -m docloom {scan,summary,schema,json,fill,compare,merge,split} ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docloom.operators import compare, forms, packets
from docloom.pdf import writer
from docloom.sources import documents


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="docloom")
    p.add_argument("job", choices=["scan", "summary", "schema", "json", "fill", "compare", "merge", "split"])
    p.add_argument("input", help="folder or file of documents")
    p.add_argument("output", help="folder that gets Parquet (scan, summary, schema, json, compare) or documents")
    p.add_argument("--table", default="text_elements", choices=sorted(documents.SCHEMAS))
    p.add_argument("--with", dest="other", help="second folder of compare; JSON rows file_id, name, value of fill")
    p.add_argument("--pages", type=int, default=1, help="pages a part of split")
    p.add_argument("--password", default="")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("docloom").getOrCreate()
    files = documents.read_files(spark, a.input)
    name = F.element_at(F.split("file_id", "/"), -1)
    if a.job == "scan":
        documents.table(files, a.table, a.password).write.parquet(a.output)
    elif a.job == "summary":
        documents.document_summary(files).write.parquet(a.output)
    elif a.job == "schema":
        read = documents.parsed(files, ["fields", "xfa"], a.password)
        packets.form_schema(documents.table(read, "fields"), documents.table(read, "xfa"), read, forms.field_kind).write.json(a.output)
    elif a.job == "json":
        documents.content_json(files, a.password).write.parquet(a.output)
    elif a.job == "compare":
        pair = lambda f: f.withColumn("pair_id", name)
        compare.compare(pair(files), pair(documents.read_files(spark, a.other))).write.parquet(a.output)
    else:
        if a.job == "fill":
            out = documents.filled(files.withColumn("file_id", name), spark.read.json(a.other))
        elif a.job == "merge":
            out = documents.merged(files.withColumn("g", F.lit("merged.pdf")), "g", "file_id").withColumnRenamed("g", "file_id")
        else:
            out = documents.transform(files, lambda d: writer.split_every(d, a.pages, a.password.encode()))
            out = out.filter("content is not null").withColumn("file_id", F.concat(F.regexp_replace(name, r"\.pdf$", ""), F.lit("-"), F.col("part").cast("string"), F.lit(".pdf")))
        # The listing of the files is written beside them, so that no row of it comes here.
        documents.save_files(out, a.output, "file_id").write.mode("overwrite").parquet(a.output.rstrip("/") + "_listing")


if __name__ == "__main__":
    main()
