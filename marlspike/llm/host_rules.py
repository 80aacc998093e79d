"""Quality rules of documents and hosts, in DataFrame functions alone.

Each whole text is judged by rules; failures are summed by host and rule in one pass. Each rule has a beta prior of its own,
fitted to the hosts' rates of that rule (moments), towards which it shrinks them. A rule speaks against a host if its posterior
rate, less SURE posterior standard deviations, still exceeds FACTOR times the corpus's rate (or, in a corpus so bad that this
is out of reach, half the way from the corpus's rate to 1): the more documents a host has, the less it must exceed that
limit. A host loses all its documents if a rule on its texts' substance (few words, repeats, either) speaks against it, or
two rules on their style (symbols, repeated lines, lengths of words) do: one alone also tells code, verse and scripts without
spaces from prose. The table of hosts, a row for each, is written once and joined back; Spark broadcasts it only below its own
size limit, and otherwise deals a hot host's rows out by its handling of skewed joins.

Cases: a null text has no word and fails; null hosts form one host; repeated rows count as often as they stand; an empty
table has no host and no result; columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.llm.common import table, without

SPACES = r"[\x20\x09-\x0D]+"
MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
#: Average lengths of words within which prose lies.
LEAST_LENGTH, MOST_LENGTH = 3, 10
#: Rules of style that must speak against a host together.
STYLE_RULES = 2
#: A host is rejected if its rate exceeds this multiple of the corpus's by so many standard deviations (one chance in 100).
FACTOR, SURE = 3.0, 2.326
#: Columns that measure adds.
MEASURED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed")
#: Limits of the prior's weight in documents.
LEAST_PRIOR, MOST_PRIOR = 1.0, 1e6


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of so many words found twice or more in the text, the first place included.

    Windows are compared by 64-bit hashes of their words' hashes; sorting keeps it at n log n for any text.
    """

    def covered(windows: Column) -> Column:
        def of_sorted(ordered: Column) -> Column:
            twin = lambda s, j: (F.get(ordered, j + 1)["v"] == s["v"]) | (F.when(j > 0, F.get(ordered, j - 1)["v"]) == s["v"])
            places = F.array_sort(F.transform(F.filter(ordered, lambda s, j: F.coalesce(twin(s, j), F.lit(False))), lambda s: s["i"]))
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
            step = lambda a, p: F.struct((a["n"] + (p + window) - F.greatest(a["end"], p.cast("long"))).cast("long").alias("n"), (p + window).cast("long").alias("end"))
            return F.aggregate(places, start, step, lambda a: a["n"])

        pairs = F.transform(windows, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(F.array_sort(pairs), of_sorted))

    def of_hashes(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(h) - (window - 1))
        return F.when(F.size(h) <= window, F.lit(0).cast("long")).otherwise(let(F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, window))), covered))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def few_words() -> Column:
    return F.col("n_words") < MIN_WORDS


def many_repeats() -> Column:
    return 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")


def substance() -> dict[str, Column]:
    """Rules of substance, by name: whether a measured text fails them."""
    return {"base": F.col("base_failed"), "few_words": few_words(), "repeats": many_repeats()}


def style() -> dict[str, Column]:
    """Rules of style, by name: over a symbol in ten words, over three in ten lines repeated, words too long or short on average."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return {"symbols": 10 * F.col("n_symbols") > words, "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"), "word_length": (chars < LEAST_LENGTH * words) | (chars > MOST_LENGTH * words)}


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of MEASURED: counts (long; n_lines: lines with a word) and base_failed (boolean)."""
    docs = without(docs, *MEASURED, "_base", "_lines")
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def base(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), repeated_words(words).alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))

    found = docs.withColumns({"_base": let(words_of(whole), base), "_lines": let(lines, of_lines)})
    wide = found.select(
        "*",
        F.col("_base.n_words").alias("n_words"),
        F.col("_base.word_chars").alias("word_chars"),
        F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.col("_lines.dup").alias("n_dup_lines"),
        F.col("_lines.n").alias("n_lines"),
        F.col("_base.n_repeat_words").alias("n_repeat_words"),
    )
    return wide.withColumn("base_failed", few_words() | many_repeats()).drop("_base", "_lines")


def _prior(n: int, k: int, square: float, m: int) -> tuple[float, float]:
    """Mean and strength (in documents) of a rule's prior, from sums over m hosts: documents n, failures k, failures squared by documents."""
    if not n:
        return 0.0, LEAST_PRIOR
    mean = k / n
    between = square / n - mean * mean
    noise = mean * (1 - mean) * m / n
    strength = (mean * (1 - mean) - between) / (between - noise) if between > noise else MOST_PRIOR
    return mean, min(max(strength, LEAST_PRIOR), MOST_PRIOR)


def hosts(measured: DataFrame, host: str = "source", factor: float = FACTOR, sure: float = SURE) -> DataFrame:
    """A row for each host, written in the shared folder: host, host_documents, host_failures (of the base rules), host_rate (theirs, shrunk),
    host_rules (array of the rules that speak against it, in their order), host_rejected."""
    rules = substance() | style()
    failed = lambda rule: F.col(f"failed_{rule}")
    counts = table(measured.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("host_documents"), *[F.count_if(fails).alias(f"failed_{rule}") for rule, fails in rules.items()]), "hosts")
    # one row of sums over the hosts
    squares = [F.sum(failed(rule) * failed(rule) / F.col("host_documents")).alias(f"square_{rule}") for rule in rules]
    sums = counts.agg(F.sum("host_documents").alias("n"), F.count(F.lit(1)).alias("m"), *[F.sum(failed(rule)).alias(f"failed_{rule}") for rule in rules], *squares).first()
    rates, against = {}, {}
    for rule in rules:
        mean, strength = _prior(sums["n"], sums[f"failed_{rule}"], sums[f"square_{rule}"], sums["m"])
        rate = (failed(rule) + F.lit(mean * strength)) / (F.col("host_documents") + F.lit(strength))
        deviation = F.sqrt(rate * (1 - rate) / (F.col("host_documents") + F.lit(strength + 1)))
        rates[rule], against[rule] = rate, rate - F.lit(sure) * deviation > F.lit(min(factor * mean, (1 + mean) / 2))
    speaking = lambda names: F.array_compact(F.array(*[F.when(against[rule], F.lit(rule)) for rule in names]))
    judged = counts.select("host", "host_documents", failed("base").alias("host_failures"), rates["base"].alias("host_rate"), speaking(substance()).alias("_substance"), speaking(style()).alias("_style"))
    rejected = (F.size("_substance") > 0) | (F.size("_style") >= STYLE_RULES)
    return judged.select("host", "host_documents", "host_failures", "host_rate", F.concat("_substance", "_style").alias("host_rules"), rejected.alias("host_rejected"))


def judge(measured: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """measured with host_rate and kept: false for documents that fail themselves or whose host is rejected."""
    measured = without(measured, "host_rate", "kept")
    named = verdicts.select(F.col("host").alias("_host"), "host_rate", "host_rejected")
    joined = measured.join(named, measured[host].eqNullSafe(named["_host"]), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))).drop("_host", "host_rejected")
