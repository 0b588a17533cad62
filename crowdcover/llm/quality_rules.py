"""Quality rules per document, judged together per host.

Each document is measured against plain rules. A host's share of documents that fail a rule says more
about its next document than the document alone, but a host of three pages has a share that means
little: per rule, shares are shrunk towards what hosts are like in general, by a beta prior fitted to
all hosts. A host is rejected with all its documents where for some rule the share it is expected to
have lies above a limit by more than CERTAIN standard deviations of its posterior. Failures are counted
rule by rule, because hosts that fail one rule often are lost in a count of documents that fail any.

Everything is column work in the JVM. A document is measured where it is read: its words become
numbers, windows of three words sort as numbers (window hash above, position below), and equal
neighbours are repeats, checked word by word. Documents are reduced to a few numbers before anything
is shuffled; hosts are counted with partial aggregates, so one host may hold any share of the rows.

Defined cases: a null or empty text has no words and fails; a null host is no host, and its documents
stand for themselves; repeated rows count as documents; with no hosts, or hosts that are all alike,
the prior is the common share with the weight DEFAULT_WEIGHT; a share at the limit does not reject.
Columns named as the output's are replaced; others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdcover.llm.common import BLANKS, let, small, unused, written

MIN_WORDS = 50
#: Percent of words in repeated windows; symbols per hundred characters; percent of repeated lines.
MAX_REPEATED, MAX_SYMBOLS, MAX_DUP_LINES = 50, 10, 30
#: The rules by name, in the order of their counts.
RULES = ["short", "repeated", "symbols", "dup_lines"]
#: Share of documents failing one rule that a host may have.
MAX_SHARE = 0.3
#: Standard deviations of the posterior by which a host's share lies above MAX_SHARE if it is rejected.
CERTAIN = 2.0
#: Documents the prior counts as where hosts don't differ more than chance would have it.
DEFAULT_WEIGHT = 1000.0

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated(words: Column) -> Column:
    """How many words lie in a window of three that occurs twice or more."""
    size = F.size(words)

    def covered(spots: Column) -> Column:
        return F.aggregate(
            F.transform(spots, lambda p, j: F.least(
                F.lit(3).cast("long"), p - F.coalesce(F.get(spots, j - 1), p - 3))),
            F.lit(0).cast("long"), lambda a, b: a + b)

    def same(a: Column, b: Column) -> Column:
        out = F.lit(True)
        for k in range(3):
            out = out & (F.get(words, (a + k).cast("int")) == F.get(words, (b + k).cast("int")))
        return out

    def spots(keys: Column, bits: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

        def alike(x: Column, other: Column) -> Column:
            equal = (F.call_function("shiftright", x, bits)
                     == F.call_function("shiftright", other, bits))
            return F.coalesce(equal & same(x.bitwiseAND(mask), other.bitwiseAND(mask)), F.lit(False))

        marked = F.transform(keys, lambda x, j: F.when(
            alike(x, F.get(keys, j - 1)) | alike(x, F.get(keys, j + 1)), x.bitwiseAND(mask)
        ).otherwise(F.lit(-1).cast("long")))
        return F.sort_array(F.filter(marked, lambda p: p >= 0))

    def keys(hashes: Column, bits: Column) -> Column:
        return F.sort_array(F.transform(F.sequence(F.lit(0), size - 3), lambda i: F.call_function(
            "shiftleft", F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)),
            bits).bitwiseOR(i.cast("long"))))

    def found(bits: Column) -> Column:
        return let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: let(
            keys(hashes, bits), lambda k: let(spots(k, bits), covered)))

    return F.when(size < 3, F.lit(0).cast("long")).otherwise(let(F.length(F.bin(size.cast("long"))), found))


def measures(text: Column) -> Column:
    """A struct of MEASURES and n_lines (lines with a word)."""
    text = F.coalesce(text, F.lit(""))

    def of_lines(lines: Column) -> list[Column]:
        return [F.size(lines).cast("long").alias("n_lines"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines")]

    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    words = F.array_remove(F.split(text, BLANKS), "")
    about_lines = let(lines, lambda x: F.struct(*of_lines(x)))
    about_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"),
                                                _repeated(w).alias("n_repeat_words")))
    return F.struct(
        about_words.alias("w"), about_lines.alias("l"),
        (F.length(text) - F.regexp_count(text, F.lit(r"[ \t-\r]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))


def measured(docs: DataFrame, text: str, failed: str = "failed") -> DataFrame:
    """``docs`` with MEASURES, base_failed, and ``failed``: per rule of RULES whether it fails."""
    m, = unused(docs, "measures")
    rest = docs.drop(*MEASURES, "base_failed", failed).withColumn(m, measures(F.col(text)))
    out = rest.select(
        *[c for c in rest.columns if c != m], F.col(f"{m}.w.n_words").alias("n_words"),
        F.col(f"{m}.word_chars").alias("word_chars"), F.col(f"{m}.n_symbols").alias("n_symbols"),
        F.col(f"{m}.l.n_dup_lines").alias("n_dup_lines"),
        F.col(f"{m}.w.n_repeat_words").alias("n_repeat_words"),
        (100 * F.col(f"{m}.l.n_dup_lines") > MAX_DUP_LINES * F.col(f"{m}.l.n_lines")).alias(failed))
    short = F.col("n_words") < MIN_WORDS
    repeated = 100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")
    symbols = 100 * F.col("n_symbols") > MAX_SYMBOLS * F.col("word_chars")
    return out.withColumns({"base_failed": short | repeated,
                            failed: F.array(short, repeated, symbols, F.col(failed))})


def host_rates(docs: DataFrame, host: str) -> DataFrame:
    """(host, n, failures, shrunk, rejected): one row per host, from the column ``failed``; the last
    three are arrays in the order of RULES."""
    rules = range(len(RULES))
    counts = [f"f{i}" for i in rules]
    hosts = written(docs.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"),
        *[F.sum(F.col("failed")[i].cast("long")).alias(c) for i, c in enumerate(counts)]))
    k, n, sizes, *sums = hosts.agg(
        F.count("*"), F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n")), *[F.sum(c) for c in counts],
        *[F.sum(F.col(c) * F.col(c) / F.col("n")) for c in counts]).first()
    shrunk, rejected = [], []
    for i, c in enumerate(counts):
        share, weight = prior(k, n or 0, sums[i] or 0, sums[i + len(RULES)] or 0.0, sizes or 0.0)
        total = F.col("n") + weight
        mean = (F.col(c) + share * weight) / total
        shrunk.append(mean)
        rejected.append(mean - CERTAIN * F.sqrt(mean * (1 - mean) / (total + 1)) > MAX_SHARE)
    return written(hosts.select("host", "n", F.array(*counts).alias("failures"),
                                F.array(*shrunk).alias("shrunk"), F.array(*rejected).alias("rejected")))


def prior(k: int, n: int, failures: int, squares: float, sizes: float) -> tuple[float, float]:
    """Mean and weight of the beta prior by moments: what the hosts' shares vary beyond chance.

    ``squares``: sum of failures^2 / n over the hosts, ``sizes``: sum of n^2."""
    if not n:
        return 0.5, DEFAULT_WEIGHT
    share = failures / n
    chance = share * (1 - share)
    if k < 2 or chance == 0 or n * n <= sizes or n <= k:
        return share, DEFAULT_WEIGHT
    between = (squares - share * share * n) / (k - 1)
    within = (failures - squares) / (n - k)
    typical = (n - sizes / n) / (k - 1)
    spread = (between - within) / (between + (typical - 1) * within)  # correlation within a host
    if spread <= 1 / (DEFAULT_WEIGHT + 1):
        return share, DEFAULT_WEIGHT
    return share, 1 / min(spread, 0.999) - 1


def judge(docs: DataFrame, text: str = "text", host: str = "source",
          carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (default all) with the measures, base_failed, host_rate (the
    largest shrunk share over the rules, null without a host), host_rules (names of the rules by which the
    host is rejected, null without a host) and kept. They are written once, with the measures beside them."""
    docs = docs.drop("host_rate", "host_rules", "kept")
    failed, = unused(docs, "failed")
    out = measured(docs, text, failed)
    own = [*MEASURES, "base_failed", failed]
    table = written(out.select(*[c for c in out.columns if c in own or carry is None
                                 or c in carry or c == host]))
    rates = host_rates(table.select(host, F.col(failed).alias("failed")), host)
    key, = unused(table, "host_key")
    verdicts = written(rates.select(
        F.col("host").alias(key), F.array_max("shrunk").alias("host_rate"),
        F.array_compact(F.array(*[F.when(F.col("rejected")[i], F.lit(r)) for i, r in enumerate(RULES)]))
        .alias("host_rules")))
    joined = table.join(small(verdicts), F.col(host) == F.col(key), "left").drop(key, failed)
    return joined.withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce(F.size("host_rules"), F.lit(0)) == 0))
