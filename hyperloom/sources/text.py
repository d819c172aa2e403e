"""Text sources: atom databases, predicate declarations, rating files, inference results, rule files, metric logs.

Each has a reader of files and a parser of a DataFrame of lines (value, line_no), so that lines from anywhere can be parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AtomSyntaxError
from ..plans.shared import cut, with_ordinal

#: name "(" argument ("," white space? argument)* ")"; letters of any script.
ATOM = r"(?U)^[\w\-']+\(([\w\-']+,\s*)*[\w\-']+\)$"
RATINGS = {
    "movies": T.StructType().add("MovieID", "integer").add("MovieTitle", "string").add("MovieGenres", "string"),
    "users": T.StructType().add("UserID", "integer").add("Gender", "string").add("Age", "integer").add("Occupation", "integer").add("ZipCode", "string"),
    "ratings": T.StructType().add("UserID", "integer").add("MovieID", "integer").add("Rating", "integer").add("Timestamp", "long"),
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no) of text files in the order of path and place; line_no counts from 0 over all of them."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    return with_ordinal(raw, "line_no", "_file", "_block", "_id").select("value", "line_no")


def is_skipped(line: Column) -> Column:
    """Blank lines and comments."""
    return F.trim(F.regexp_replace(line, r"\s", " ")).eqNullSafe("") | F.ltrim(F.regexp_replace(line, r"^\s+", "")).startswith("//")


def is_atom(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "").rlike(ATOM)


def parse_atoms(lines: DataFrame, mode: str = "FAILFAST", file: str = "input") -> DataFrame:
    """(edge_id, predicate, args, _corrupt): edge_id counts all lines that aren't skipped, by line_no.

    FAILFAST raises AtomSyntaxError on the first bad line; PERMISSIVE keeps it as ``_corrupt`` with null predicate and args.
    """
    kept = lines.filter(~is_skipped(F.col("value"))).withColumn("line", F.regexp_replace("value", r"^\s+|\s+$", ""))
    if mode == "FAILFAST":
        bad = kept.filter(~is_atom(F.col("line"))).orderBy("line_no").limit(1).collect()
        if bad:
            raise AtomSyntaxError(bad[0].line_no + 1, file, bad[0].value)
    good, inside = is_atom(F.col("line")), F.regexp_extract("line", r"\((.*)\)$", 1)
    rows = with_ordinal(kept, "edge_id", "line_no")
    return rows.select(
        "edge_id", F.when(good, F.regexp_extract("line", r"^([^(]*)\(", 1)).alias("predicate"),
        F.when(good, F.transform(F.split(inside, ","), lambda a: F.trim(a))).alias("args"), F.when(~good, F.col("line")).alias("_corrupt"),
    )


def parse_info(lines: DataFrame) -> DataFrame:
    """(predicate, arg_types) of declarations; a later line for the same predicate wins."""
    kept = lines.filter(~is_skipped(F.col("value")))
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    types = F.transform(F.split(F.regexp_extract(line, r"\((.*)\)", 1), ","), lambda a: F.trim(a))
    return kept.select(F.regexp_extract(line, r"^([^(]*)\(", 1).alias("predicate"), types.alias("arg_types"), "line_no").groupBy("predicate").agg(F.max_by("arg_types", "line_no").alias("arg_types"))


def query_predicates(lines: DataFrame) -> DataFrame:
    """One row with the declared names in file order, comma-joined: lines that start with // (unindented) and blank ones are left out."""
    names = lines.filter(~F.col("value").startswith("//") & (F.trim("value") != "")).select("line_no", F.split("value", r"\(")[0].alias("name"))
    return names.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "name"))), lambda r: r["name"]), ",").alias("query_predicates"))


def read_ratings(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """movies, users and ratings of a folder with ``::``-delimited files."""
    return {n: spark.read.csv(f"{folder}/{n}.dat", sep="::", schema=s, encoding="ISO-8859-1") for n, s in RATINGS.items()}


def parse_inference(lines: DataFrame) -> DataFrame:
    """(ground_atom, prob, line_no) of blank-delimited results; repeated atoms all take the first one's probability."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select(parts[0].alias("ground_atom"), F.expr("try_cast(split(trim(value), '\\\\s+')[1] as double)").alias("own"), "line_no").filter("own is not null")
    first = rows.groupBy("ground_atom").agg(F.min_by("own", "line_no").alias("prob"))
    return rows.drop("own").join(first, "ground_atom")


def parse_rules(lines: DataFrame) -> DataFrame:
    """(weight, clause, n_literals) of weighted lines of a rule file."""
    rows = lines.select(F.regexp_extract("value", r"^\s*(\S+)\s+(.*?)\s*$", 1).alias("w"), F.regexp_extract("value", r"^\s*(\S+)\s+(.*?)\s*$", 2).alias("clause"))
    rows = rows.withColumn("weight", F.expr("try_cast(w as double)")).filter("weight is not null and clause <> ''")
    return rows.select("weight", "clause", F.size(F.split("clause", " v ")).cast("long").alias("n_literals"))


def parse_log(lines: DataFrame) -> DataFrame:
    """(key, value, line_no) of ``key, value`` lines; lines whose value is no number are left out."""
    rows = lines.select(F.trim(F.regexp_extract("value", r"^(.*),([^,]*)$", 1)).alias("key"), F.expr("try_cast(trim(regexp_extract(value, '^(.*),([^,]*)$', 2)) as double)").alias("number"), "line_no")
    return rows.filter("number is not null").select("key", F.col("number").alias("value"), "line_no")


def scan_hypergraph(spark: SparkSession, database: str | None = None, info: str | None = None, mode: str = "FAILFAST") -> tuple[DataFrame, DataFrame]:
    """(atoms, predicates) of a database and its declarations: both files or neither (then empty)."""
    if (database is None) != (info is None):
        raise ValueError("give both a database and an info file, or neither")
    if database is None:
        return spark.createDataFrame([], "edge_id long, predicate string, args array<string>"), spark.createDataFrame([], "predicate string, arg_types array<string>")
    return cut(parse_atoms(read_lines(spark, database), mode, database).drop("_corrupt")), parse_info(read_lines(spark, info))
