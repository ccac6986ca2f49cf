"""Quality rules: a decision list learned by sequential covering, with DataFrame functions only.

Every text gets one row of statistics. From the labelled ones a list of rules is learned: a rule is a
conjunction of thresholds on statistics that rejects a text. Growing adds the threshold with the best
FOIL gain on two thirds of the labelled rows; pruning drops conditions from the end while that does not
lower (p - n) / (p + n) on the other third. Rows that a rule covers are set aside, and the next rule is
learned from the rest, until a rule is not better than chance or not precise enough. The list becomes one
ordered CASE expression, so applying it is a projection.

All counting is aggregation in Spark: each candidate's counts come from one histogram a step (statistic,
bin, class), of a size that depends on the number of statistics and bins only.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlloom.llm.staging import broadcast_if, cut, stage

#: Labelled rows that the rules are learned from: at most this many, those with the smallest hash of doc_id.
LABELLED_ROWS = 20_000
#: Rejected texts' hashes are sent to all executors up to this many (8 bytes each), else joined by shuffle.
BROADCAST_ROWS = 1 << 20
#: Bins of a statistic; conditions of a rule; rules of a list.
BINS, CONDITIONS, RULES = 32, 3, 8
#: A rule must reach this precision on both parts, and cover so many bad rows while growing.
PRECISION, COVER = 0.9, 3
#: The base test: fewer words, or a larger percentage of words in repeated 3-word windows, fails.
MIN_WORDS, MAX_REPEATED = 50, 50

#: The words of a text, and the symbols counted in it.
WORD, SYMBOL = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]"

#: The statistics that rules may test; each is a ratio or a mean, so that length alone decides nothing.
STATISTICS = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
    "upper_per_char": "n_upper / greatest(word_chars, 1)",
    "digits_per_char": "n_digits / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "distinct_words": "n_distinct / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def _count_of(text: str, pattern: str) -> str:
    return f"(char_length({text}) - char_length(regexp_replace({text}, '{pattern}', '')))"


def statistics(docs: DataFrame, *more: str) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules test; then columns of SQL over docs."""
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *map(F.expr, more))
    marked = marked.withColumn("words", F.expr(f"regexp_extract_all(text, r'{WORD}', 0)"))
    marked = marked.withColumn("lines", F.expr(r"filter(split(text, '\n'), l -> l rlike r'[^\x20\x09-\x0D]')"))
    # One long for each 3-word window, then the windows sorted by it: equal ones become neighbours.
    marked = marked.withColumn("windows", F.expr("if(size(words) < 3, cast(array() as array<bigint>), transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])))"))
    marked = marked.withColumn("sorted", F.expr("sort_array(windows)"))
    marked = marked.withColumn("twice", F.expr("array_distinct(filter(sorted, (h, i) -> i > 0 and h = sorted[i - 1]))"))
    # Only texts with a repeated window look for its places: sorted (hash, place) pairs, equal hashes adjacent.
    marked = marked.withColumn(
        "pairs", F.expr("if(size(twice) = 0, cast(array() as array<struct<h:bigint,i:int>>), sort_array(transform(windows, (h, i) -> named_struct('h', h, 'i', i))))")
    )
    marked = marked.withColumn("places", F.expr("filter(pairs, (p, i) -> (i > 0 and pairs[i - 1].h = p.h) or (i < size(pairs) - 1 and pairs[i + 1].h = p.h)).i"))
    return marked.select(
        "doc_id",
        F.expr("cast(size(words) as bigint)").alias("n_words"),
        F.expr(r"cast(char_length(regexp_replace(text, r'[\x20\x09-\x0D]+', '')) as bigint)").alias("word_chars"),
        F.expr(f"cast({_count_of('text', SYMBOL)} as bigint)").alias("n_symbols"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)").alias("n_dup_lines"),
        F.expr("cast(size(array_distinct(flatten(transform(places, i -> array(i, i + 1, i + 2))))) as bigint)").alias("n_repeat_words"),
        F.expr("size(lines)").alias("n_lines"),
        F.expr("size(array_distinct(words))").alias("n_distinct"),
        F.expr(_count_of("text", "[A-Z]")).alias("n_upper"),
        F.expr(_count_of("text", "[0-9]")).alias("n_digits"),
        F.expr(_count_of("text", "[!?]")).alias("n_marks"),
        *[x.rpartition(" ")[2] for x in more],
    )


def _with_tested(stats: DataFrame) -> DataFrame:
    return stats.select("*", *[F.expr(f"cast({x} as double)").alias(k) for k, x in STATISTICS.items()])


def _fires(rule: Rule) -> Column:
    return F.expr(" and ".join(c.sql() for c in rule) or "true")


def _histogram(rows: DataFrame, thresholds: dict[str, list[float]]) -> dict[tuple[str, bool], list[list[int]]]:
    """(statistic, held back) -> for each bin [good, bad]; bin i holds values over i of the thresholds."""
    bins = [f"'{k}', {' + '.join(f'cast({k} > {t!r}D as int)' for t in ts) or '0'}" for k, ts in thresholds.items()]
    counted = rows.select("bad", "back", F.expr(f"stack({len(bins)}, {', '.join(bins)}) as (statistic, bin)")).groupBy("statistic", "bin", "back", "bad").count()
    out = {(k, b): [[0, 0] for _ in range(len(ts) + 1)] for k, ts in thresholds.items() for b in (False, True)}
    for r in counted.collect():  # at most statistics x bins x 4 rows
        out[r["statistic"], r["back"]][r["bin"]][int(r["bad"])] += r["count"]
    return out


def _totals(rows: DataFrame, rule: Rule) -> list[dict[bool, tuple[int, int]]]:
    """For each length of the rule's beginning: held back -> (bad, good) that it covers."""
    parts = [f"count_if({' and '.join(c.sql() for c in rule[:n]) or 'true'} and bad = {b}) as c{n}_{int(b)}" for n in range(len(rule) + 1) for b in (True, False)]
    got = {r["back"]: r for r in rows.groupBy("back").agg(*map(F.expr, parts)).collect()}
    return [{b: (got[b][f"c{n}_1"], got[b][f"c{n}_0"]) if b in got else (0, 0) for b in (False, True)} for n in range(len(rule) + 1)]


def _grow(rows: DataFrame, thresholds: dict[str, list[float]]) -> Rule:
    rule: list[Condition] = []
    while len(rule) < CONDITIONS:
        best, gain = None, 0.0
        counts = _histogram(rows.where(_fires(tuple(rule))), thresholds)
        good, bad = (sum(b[i] for b in next(iter(counts.values()))) for i in (0, 1))
        if not bad or not good and rule:
            break
        before = log2(bad / (bad + good))
        for k, ts in thresholds.items():
            bins, under = counts[k, False], [0, 0]
            for i, t in enumerate(ts):
                under = [under[0] + bins[i][0], under[1] + bins[i][1]]
                for above, (n, p) in ((False, under), (True, [good - under[0], bad - under[1]])):
                    if p >= COVER and (g := p * (log2(p / (p + n)) - before)) > gain + 1e-9:
                        best, gain = Condition(k, above, t), g
        if best is None:
            break
        rule.append(best)
    return tuple(rule)


def learn_rules(labelled: DataFrame) -> list[Rule]:
    """The rejecting rules, in order; ``labelled``: the statistics, doc_id and quality (1 good, 0 bad)."""
    rows = labelled.where("quality in (0, 1)").select(*STATISTICS, (F.col("quality") == 0).alias("bad"), F.xxhash64("doc_id", F.lit("rules")).alias("place"))
    rows = cut(rows.orderBy("place", *STATISTICS).limit(LABELLED_ROWS).withColumn("back", F.expr("pmod(place, 3) = 0")).coalesce(4))
    points = [i / BINS for i in range(1, BINS)]
    cuts = rows.agg(*[F.expr(f"percentile_approx(if(bad = {b}, {k}, null), array({', '.join(map(str, points))}), 1000)").alias(f"{k}_{b}") for k in STATISTICS for b in ("true", "false")]).first()
    thresholds = {k: sorted({*(cuts[f"{k}_true"] or []), *(cuts[f"{k}_false"] or [])}) for k in STATISTICS}
    rules: list[Rule] = []
    while len(rules) < RULES:
        rule = _grow(rows, thresholds)
        if not rule:
            break
        totals = _totals(rows, rule)
        worth = lambda pn: (pn[0] - pn[1]) / max(1, sum(pn))
        keep = len(rule)
        while keep > 1 and worth(totals[keep - 1][True]) >= worth(totals[keep][True]):
            keep -= 1
        (p, n), (q, m) = totals[keep][False], totals[keep][True]
        if p < COVER or p < PRECISION * (p + n) or q < PRECISION * (q + m):
            break
        rules.append(rule[:keep])
        rows = cut(rows.where(~_fires(rule[:keep])))
    return rules


def rule_expression(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the number of the first rule that fires, else 0."""
    out = "case" + "".join(f" when {' and '.join(c.sql() for c in r)} then {i}" for i, r in enumerate(rules, 1)) + " else 0 end"
    return F.expr(out if rules else "0")


def _judged(docs: DataFrame, labels: DataFrame, *more: str) -> DataFrame:
    """Per row of ``docs``: the statistics, base_failed, rule, kept, and the columns ``more`` of SQL over docs."""
    stats = stage(statistics(docs, *more), "statistics")
    tested = _with_tested(stats)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    rules = learn_rules(tested.join(marks, "doc_id"))
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words")
    judged = tested.withColumn("base_failed", failed).withColumn("rule", rule_expression(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the base statistics, base_failed, rule (number, 0: none) and kept.

    ``labels``: doc_id, quality. A null text has no words and fails the base test, as an empty one does. A
    row with a null id is judged like the others; rows repeated under one id give one row each, and count
    as often in learning. Without labels, or without two classes, there are no rules and the base decides.
    """
    return _judged(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept; a row goes by its own text, also where its id is null or repeated."""
    mark = "text_hash_"
    rejected = stage(_judged(docs, labels, f"xxhash64(text) as {mark}").where("not kept").select(mark).distinct(), "rejected")
    return docs.withColumn(mark, F.xxhash64("text")).join(broadcast_if(rejected, BROADCAST_ROWS), mark, "left_anti").select(*docs.columns)
