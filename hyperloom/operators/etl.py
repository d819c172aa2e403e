"""Relational rows to ground atoms: ratings data, and the same shapes over any tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many movies and users the full data has (fixed values; filters are strict on id < share * count, without a share there is none).
MOVIES, USERS = 3952, 6040
#: Age codes of the users file (fixed values).
AGES = {"Youthful": (1, 18, 25), "MiddleAged": (35, 45, 50), "Old": (56,)}


def atom(name: Column, *args: Column) -> Column:
    return F.concat(name, F.lit("("), F.concat_ws(",", *args), F.lit(")"))


def explode_atoms(df: DataFrame, words: Column, arg: Column) -> DataFrame:
    """One atom word(arg) for each of an array of words."""
    return df.select(F.explode(words).alias("w"), arg.alias("a")).select(atom(F.col("w"), F.col("a")).alias("atom"))


def _below(df: DataFrame, column: str, count: int, scale: float | None) -> DataFrame:
    """Rows with an id under a share of the count; None keeps all."""
    return df if scale is None else df.filter(F.col(column) < count * scale)


def movie_atoms(movies: DataFrame, scale: float | None = 1.0) -> DataFrame:
    return explode_atoms(_below(movies, "MovieID", MOVIES, scale), F.split("MovieGenres", r"\|"), F.concat(F.lit("M"), F.col("MovieID").cast("string")))


def user_atoms(users: DataFrame, scale: float | None = 1.0) -> DataFrame:
    """Gender and age atoms; unknown values give none."""
    sex = F.when(F.col("Gender") == "M", "Male").when(F.col("Gender") == "F", "Female")
    age = F.lit(None).cast("string")
    for name, codes in AGES.items():
        age = F.when(F.col("Age").isin(*codes), name).otherwise(age)
    known = F.filter(F.array(sex, age), lambda x: x.isNotNull())
    return explode_atoms(_below(users, "UserID", USERS, scale), known, F.concat(F.lit("U"), F.col("UserID").cast("string")))


def rating_atoms(ratings: DataFrame, scale: float | None = 1.0) -> DataFrame:
    kept = _below(_below(ratings, "UserID", USERS, scale), "MovieID", MOVIES, scale)
    name = F.when(F.col("Rating") >= 4, "Positive").when(F.col("Rating") == 3, "Indifferent").when(F.col("Rating") <= 2, "Negative")
    return kept.filter(name.isNotNull()).select(atom(name, F.concat(F.lit("U"), F.col("UserID").cast("string")), F.concat(F.lit("M"), F.col("MovieID").cast("string"))).alias("atom"))


def rating_database(tables: dict[str, DataFrame], scale: float | None = 1.0) -> DataFrame:
    """(section, atom): movies, users, ratings."""
    parts = (movie_atoms(tables["movies"], scale), user_atoms(tables["users"], scale), rating_atoms(tables["ratings"], scale))
    out = None
    for i, p in enumerate(parts):
        p = p.select(F.lit(i).alias("section"), "atom")
        out = p if out is None else out.unionByName(p)
    return out
