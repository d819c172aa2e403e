"""Evaluation of learnt logic models: leave-one-out lists, experiment grids, conditional log-likelihood, formula and timing summaries.

Motif finding is the library's own or an external program's; the external learners are reached through ``Tool``, a timed subprocess with a timeout.
``Experiment`` learns, infers and evaluates, and logs times, scores and statistics.
"""

from __future__ import annotations

import itertools
import os
import statistics
import subprocess
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ExperimentConfig
from ..sources import text

SUFFIXES = {"baseline": "_rwl", "hyperloom": "_hl"}


def leave_one_out(databases: DataFrame) -> DataFrame:
    """(test, train): for each database the comma-joined others, by name. The list of databases is the small side by nature."""
    a, b = databases.select(F.col("name").alias("test")).distinct(), databases.select(F.col("name").alias("other")).distinct()
    j = a.join(b, F.col("test") != F.col("other"), "left")
    return j.groupBy("test").agg(F.array_join(F.sort_array(F.collect_list("other")), ",").alias("train"))


def experiment_grid(databases: DataFrame, methods: DataFrame, predicates: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """Every (database, method[, predicate]); ``first`` databases by name."""
    d = databases.select(F.col("name").alias("database")).distinct()
    d = d.orderBy("database").limit(first) if first else d
    out = d.join(F.broadcast(methods.select("method").distinct()))  # methods are a handful
    return out.join(F.broadcast(predicates.select("predicate").distinct())) if predicates is not None else out


def suffix(method: str) -> str:
    if method not in SUFFIXES:
        raise ValueError(f"unknown method {method}")
    return SUFFIXES[method]


def learnt_name(database: Column, method: Column) -> Column:
    """Name of the model that never saw the database."""
    s = F.raise_error(F.lit("unknown method")).cast("string")
    for m, x in SUFFIXES.items():
        s = F.when(method == m, F.lit(x)).otherwise(s)
    return F.concat(F.lit("NOT"), database, s)


def cll(results: DataFrame, by: list[str]) -> DataFrame:
    """results(by..., ground_atom, prob, positive, line_no) -> by..., cll = ln(mean p of the truth), mean_ll = mean(ln p), n.

    Repeated ground atoms of a result all take the first one's probability.
    """
    w = Window.partitionBy(*by, "positive", "ground_atom").orderBy("line_no")
    p = F.first("prob").over(w)
    rows = results.select(*by, F.when(F.col("positive"), p).otherwise(1 - p).alias("p"))
    return rows.groupBy(*by).agg(F.log(F.avg("p")).alias("cll"), F.avg(F.log(F.when(F.col("p") > 0, F.col("p")))).alias("mean_ll"), F.count("*").alias("n"))


def formula_stats(rules: DataFrame) -> DataFrame:
    """One row of parsed rules: average and largest number of literals, number of formulas; -1 each if there are none."""
    return rules.agg(F.coalesce(F.avg("n_literals"), F.lit(-1.0)).alias("avg_length"), F.coalesce(F.max("n_literals"), F.lit(-1)).cast("long").alias("max_length"), F.when(F.count("*") > 0, F.count("*")).otherwise(-1).alias("n_formulas"))


def first_values(log: DataFrame) -> DataFrame:
    """(key, value): the first value of each database."""
    return log.groupBy("key").agg(F.min_by("value", "line_no").alias("value"))


def summary(log: DataFrame) -> DataFrame:
    """mean and population deviation over databases, rounded half to even at 4 places, and their number."""
    return first_values(log).agg(F.bround(F.avg("value"), 4).alias("mean"), F.bround(F.stddev_pop("value"), 4).alias("std"), F.count("*").alias("n"))


def is_number(token: Column) -> Column:
    return F.regexp_like(token, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"))


def numbers_in(text: Column) -> Column:
    """The numbers of free text, in order."""
    return F.transform(F.filter(F.split(F.regexp_replace(text, "[,:;]", " "), r"\s+"), is_number), lambda t: t.cast("double"))


def mln_summary(stats: DataFrame) -> DataFrame:
    """stats(avg_length, n_formulas) -> length averaged over formulas, deviation of lengths over models, mean number of formulas."""
    return stats.agg(
        (F.sum(F.col("avg_length") * F.col("n_formulas")) / F.sum("n_formulas")).alias("avg_length"), F.stddev_pop("avg_length").alias("std_length"), F.avg("n_formulas").alias("avg_formulas"),
    )


def fan_out(methods: DataFrame, quantities: list[str]) -> DataFrame:
    """(method, quantity, log): the log of each method and quantity."""
    return methods.select("method", F.explode(F.array(*map(F.lit, quantities))).alias("quantity")).withColumn("log", F.concat_ws("_", "method", "quantity"))


class MotifTimeout(Exception):
    """Motif finding took longer than it may."""


@dataclass(frozen=True)
class Tool:
    """An external program of the learning pipeline, run with a timeout; dry runs only return the command."""

    program: str
    timeout: float | None = None

    def run(self, *args: str, dry: bool = False) -> tuple[list[str], float | None]:
        command = [self.program, *args]
        if dry:
            return command, None
        began = time.monotonic()
        subprocess.run(command, check=True, timeout=self.timeout, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
        return command, time.monotonic() - began


def remove_temporary(folder: str, suffixes: tuple[str, ...]) -> list[str]:
    """Delete files of a folder by suffix; returns what went."""
    gone = [f for f in sorted(os.listdir(folder)) if f.endswith(suffixes)]
    for f in gone:
        os.remove(os.path.join(folder, f))
    return gone


#: What the external motif finder is called with after its three inputs (fixed values): walks, length, two precisions, the thresholds of hitting time,
#: symmetry and divergence, paths compared, and a switch.
BASELINE_WALKS = ("10000", "5", "0.05", "0.1", "4.9", "0.1", "1", "3", "1")
#: Epsilon, alpha, multiprocessing, largest lambda2 and smallest cluster of the own motif finder when it runs as a program (fixed values).
OWN_PARAMETERS = ("0.1", "0.001", "1", "0.8", "10")
#: Arguments of the other programs around their files (fixed values).
COMMUNITY_COUNT, COMMUNITY_REST = "10", ("NOOP", "true", "1")
PATH_LIMITS = ("5", "0", "5", "-1.0")
RULE_LIMITS, RULE_REST = ("0.5", "0.1", "0.1", "100", "5", "100", "1000", "5"), ("1", "-", "-", "true", "false", "40")
INFERENCE_STEPS = ("-maxSteps", "300")
#: What structure learning leaves behind.
TEMPORARY, GENERATED = ("_tmpalchemy.mln",), (".ldb", ".uldb", ".srcnclusts")


@dataclass(frozen=True)
class Folders:
    """Where an experiment reads and writes."""

    data: str
    results: str
    models: str
    inference: str
    master: str | None = None


@dataclass(frozen=True)
class Programs:
    """Paths of the external programs; ``own`` is None where the library finds motifs itself."""

    walks: str = "rwl"
    communities: str = "getcom"
    paths: str = "pfind"
    rules: str = "createrules"
    weights: str = "learnwts"
    infer: str = "infer"
    scratch: str = "tmpdir"
    own: str | None = None


def run_program(command: list[str], timeout: float | None = None) -> None:
    """Run a command silently; what a program returns is not looked at, as programs that fail leave no output and so show in the evaluation."""
    subprocess.run(command, check=False, timeout=timeout, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)


def library_motifs(spark: SparkSession, database: str, info: str, out: str, timeout: float | None) -> None:
    """The three community files of a database by this library: hierarchy, walks, symmetry tests. Jobs are cancelled after the timeout."""
    from threading import Timer

    from ..config import WalkConfig
    from ..sources import writer
    from .communities import communities
    from .hypergraph import Hypergraph

    context, group = spark.sparkContext, f"motifs-{out}"
    late = []

    def stop():
        late.append(True)
        context.cancelJobGroup(group)

    timer = Timer(timeout, stop) if timeout else None
    context.setJobGroup(group, "motif finding", interruptOnCancel=True)
    try:
        if timer:
            timer.start()
        hg = Hypergraph(*text.scan_hypergraph(spark, database, info))
        config = WalkConfig(epsilon=float(OWN_PARAMETERS[0]), alpha_sym=float(OWN_PARAMETERS[1]))
        found = communities(hg, config, config.max_path_length)
        writer.write_files(hg, found, f"{out}.parts")
        for suffix in GENERATED:
            join_parts(f"{out}.parts{suffix}", f"{out}{suffix}")
    except Exception as e:
        if late:
            raise MotifTimeout(str(timeout)) from e
        raise
    finally:
        if timer:
            timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)


def join_parts(folder: str, path: str) -> None:
    """The text parts of a folder as one file, for programs that read files."""
    with open(path, "wb") as out:
        for name in sorted(f for f in os.listdir(folder) if f.startswith("part-")):
            with open(os.path.join(folder, name), "rb") as part:
                while block := part.read(1 << 20):
                    out.write(block)


@dataclass
class Experiment:
    """One configuration of learning, inference and evaluation.

    ``run`` executes a command (list of arguments, timeout in seconds or None); ``motifs`` makes the community files of (database path, info path, output stem,
    timeout) where the own method has no program.
    """

    config: ExperimentConfig
    folders: Folders
    info: str
    types: str
    programs: Programs = field(default_factory=Programs)
    run: Callable[[list[str], float | None], None] = run_program
    motifs: Callable[[str, str, str, float | None], None] | None = None
    parallel: int = 1

    # ---- names

    @property
    def tests(self) -> tuple[str, ...]:
        return self.config.databases[: self.config.number_of_tests]

    def stem(self, database: str, method: str) -> str:
        return database.removesuffix(".db") + suffix(method)

    def _data(self, name: str) -> str:
        return os.path.join(self.folders.data, name)

    def _others(self, database: str) -> list[str]:
        return [d for d in self.config.databases if d != database]

    def _result(self, database: str, method: str, sign: str) -> str:
        return os.path.join(self.folders.inference, f"NOT{self.stem(database, method)}.{database.removesuffix('.db')}.results.{sign}")

    def _model(self, database: str, method: str) -> str:
        return os.path.join(self.folders.models, f"NOT{self.stem(database, method)}-rules-out.mln")

    # ---- commands

    def motif_command(self, database: str, method: str) -> list[str] | None:
        """The motif finder's command; None where the library finds motifs itself."""
        out = os.path.join(self.folders.results, self.stem(database, method))
        if method == "baseline":
            return [self.programs.walks, self._data(self.info), self._data(database), self._data(self.types), *BASELINE_WALKS, *(out + s for s in GENERATED)]
        if self.programs.own is None:
            return None
        return [self.programs.own, self._data(database), self._data(self.info), out, *OWN_PARAMETERS]

    def learning_commands(self, database: str, method: str) -> list[list[str]]:
        """Communities, paths, rules and weights of the model that never saw the database."""
        f, p, name = self.folders, self.programs, f"NOT{self.stem(database, method)}"
        mine = lambda s: ",".join(os.path.join(f.results, self.stem(d, method) + s) for d in self._others(database))
        databases, info = ",".join(self._data(d) for d in self._others(database)), self._data(self.info)
        combined, rules = os.path.join(f.results, f"{name}.comb.ldb"), os.path.join(f.results, f"{name}.rules")
        model = os.path.join(f.models, f"{name}-rules.mln")
        return [
            [p.communities, mine(".ldb"), mine(".uldb"), mine(".srcnclusts"), info, COMMUNITY_COUNT, combined, *COMMUNITY_REST],
            [p.paths, combined, *PATH_LIMITS, info, rules],
            [p.rules, rules, "0", databases, combined, mine(".uldb"), info, p.weights, p.scratch, *RULE_LIMITS, model, *RULE_REST],
            [p.weights, "-g", "-i", model, "-o", self._model(database, method), "-t", databases],
        ]

    def inference_commands(self, database: str, method: str, query_predicates: str) -> list[list[str]]:
        """Inference given positive evidence, then negative."""
        base = lambda sign: [self.programs.infer, "-i", self._model(database, method), "-r", self._result(database, method, sign), "-e", self._data(database), "-q", query_predicates, *INFERENCE_STEPS]
        return [[*base("positive"), "-queryEvidence", "1"], base("negative")]

    def commands(self, query_predicates: str) -> list[list[str]]:
        """All external commands in the order in which they run."""
        out = []
        for m in self.config.active:
            out += [c for d in self.config.databases if (c := self.motif_command(d, m))]
            out += [c for d in self.tests for c in self.learning_commands(d, m)]
        for d, m in itertools.product(self.tests, self.config.active):
            out += [c for q in self._asked(query_predicates) for c in self.inference_commands(d, m, q)]
        return out

    def _asked(self, query_predicates: str) -> list[str]:
        return query_predicates.split(",") if self.config.individual_query_predicates else [query_predicates]

    # ---- the run

    def log(self, method: str, quantity: str, database: str, result, test: str | None = None) -> None:
        if self.folders.master is not None:
            with open(f"{self.folders.master}_{method}_{quantity}", "a") as f:
                f.write(f"{database}, {result}\n" if test is None else f"{database} MLN on {test}, {result}\n")

    def _summary(self, method: str, quantity: str, label: str, times: list[float], test: str | None = None) -> None:
        if times:
            self.log(method, quantity, label, f"{round(statistics.fmean(times), 4)} +/- {round(statistics.pstdev(times), 4)}", test)

    def _each(self, f, items: list) -> list:
        if self.parallel <= 1:
            return [f(*x) for x in items]
        with ThreadPoolExecutor(self.parallel) as pool:
            return list(pool.map(lambda x: f(*x), items))

    def find_motifs(self, method: str) -> list[float]:
        """Motif files of every database, timed; a timeout is logged as an error and the run goes on."""
        times = []
        for d in self.config.databases:
            command, began = self.motif_command(d, method), time.monotonic()
            try:
                if command:
                    self.run(command, None if method == "baseline" else self.config.motif_timeout)
                else:
                    self.motifs(self._data(d), self._data(self.info), os.path.join(self.folders.results, self.stem(d, method)), self.config.motif_timeout)
            except (subprocess.TimeoutExpired, MotifTimeout):
                self.log(method, "errors", d, f"motif finding on this database took more than {self.config.motif_timeout}s")
            times.append(time.monotonic() - began)
            self.log(method, "motif_time", d, times[-1])
        self._summary(method, "motif_time", "database average and std:", times)
        return times

    def learn(self) -> None:
        """Structure and weights of a model for each test database and method."""
        for m in self.config.active:
            self.find_motifs(m)

            def one(d: str, m: str = m) -> float:
                began = time.monotonic()
                for c in self.learning_commands(d, m):
                    self.run(c, None)
                self.log(m, "structure_learning_time", "all others", took := time.monotonic() - began, d)
                return took

            self._summary(m, "structure_learning_time", "average all others", self._each(one, [(d,) for d in self.tests]), "leave one out")

    def infer(self, spark: SparkSession) -> None:
        """Inference of every test database under every method's model; with individual predicates the results of all are put together."""
        asked = self._asked(text.query_predicates(text.read_lines(spark, self._data(self.info))).first()[0])

        def one(d: str, m: str) -> None:
            said: dict[str, bytes] = {"positive": b"", "negative": b""}
            for q in asked:
                for c in self.inference_commands(d, m, q):
                    self.run(c, None)
                for sign in said:
                    if os.path.exists(path := self._result(d, m, sign)):
                        with open(path, "rb") as f:
                            said[sign] += f.read()
            for sign, whole in said.items():
                if len(asked) > 1:
                    with open(self._result(d, m, sign), "wb") as f:
                        f.write(whole)

        self._each(one, list(itertools.product(self.tests, self.config.active)))

    def evaluate(self, spark: SparkSession) -> list[dict]:
        """CLL and formula statistics of each test database and method, logged and returned."""
        out = []
        for m, d in itertools.product(self.config.active, self.tests):
            signs = [text.parse_inference(text.read_lines(spark, self._result(d, m, sign))).withColumn("positive", F.lit(sign == "positive")) for sign in ("positive", "negative")]
            score = cll(signs[0].unionByName(signs[1]).withColumn("test", F.lit(d)), ["test"]).first()
            stats = formula_stats(text.parse_rules(text.read_lines(spark, self._model(d, m)))).first()
            value = score.cll if score else None
            self.log(m, "inference_result", f"NOT{d}", value, d)
            self.log(m, "mln_statistics", f"NOT{d}", f"#formulas {stats.n_formulas} avg formula length {stats.avg_length} max formula length {stats.max_length}")
            out.append({"method": m, "test": d, "cll": value, **stats.asDict()})
        return out

    def execute(self, spark: SparkSession, skip_learning: bool = False, skip_inference: bool = False, skip_evaluation: bool = False) -> list[dict]:
        """Learn, infer, evaluate; each part can be skipped."""
        if not skip_learning:
            if self.motifs is None:
                self.motifs = lambda *args: library_motifs(spark, *args)
            self.learn()
        if not skip_inference:
            self.infer(spark)
        return [] if skip_evaluation else self.evaluate(spark)

    def clean(self, generated: bool = False) -> list[str]:
        """Remove temporary models of the working folder and, if asked, community files."""
        gone = remove_temporary(os.getcwd(), TEMPORARY)
        return gone + (remove_temporary(self.folders.results, GENERATED) if generated else [])
