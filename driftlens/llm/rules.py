"""Operator 7, quality rules as weak supervision, in DataFrame functions only.

Each rule looks at counts of the text and votes good (1), bad (0) or abstains (-1).  A
document that fails the base limits (too few words, or too many in repeated windows) is
never kept.  For the others, expectation-maximisation over how often each combination of
votes occurs estimates the share of good texts and, for each rule, how likely it calls good
texts good and bad texts bad; a text stays if the posterior probability that it is good
reaches ``KEEP``.  The limits' own counts are no rules, and documents that fail them are no
evidence, so the classes cannot settle on what the limits find anyway.

Which class is the good one is fixed by a bound: no rule may be worse than chance
(``ABOVE_CHANCE``), so a bad vote never speaks for a text.  EM runs from several starts;
the likeliest end counts.

The counts come from array functions inside one scan: no text is shuffled.  Combinations
of votes are at most 3**rules, whatever the corpus; their counts are all that the driver
sees.  Null texts count as empty; null ids and repeated rows are rows like others; other
columns, whatever their names, are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

MIN_WORDS, WINDOW, MAX_REPEAT, KEEP, ROUNDS, ABOVE_CHANCE = 20, 8, 30, 0.5, 100, 0.05
_SYMBOLS, _BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
_STOPS = (".", "!", "?", "\"", "”", ")", "。", "！", "？")

#: Repeated words of the array ``w``: windows as (hash, place) in order of hashes; those
#: equal to a neighbour; then the words that their places cover.  ``transform(array(x),
#: v -> ...)[0]`` gives x a name, so that it is computed once.
_REPEATED = f"""
CASE WHEN size(w) <= {WINDOW} THEN 0L ELSE
transform(array(sort_array(transform(sequence(0, size(w) - {WINDOW}), i -> struct(xxhash64(slice(w, i + 1, {WINDOW})) AS h, i AS p)))), s ->
  transform(array(sort_array(transform(filter(sequence(0, size(s) - 1), j ->
      (j > 0 AND s[j].h = s[greatest(j - 1, 0)].h) OR (j < size(s) - 1 AND s[j].h = s[least(j + 1, size(s) - 1)].h)), j -> s[j].p))), p ->
    aggregate(sequence(0, size(p)), 0L, (t, k) -> t + CASE WHEN k >= size(p) THEN 0 WHEN k = size(p) - 1 THEN {WINDOW} ELSE least({WINDOW}, p[least(k + 1, size(p) - 1)] - p[k]) END)
  )[0])[0] END"""


def counts(df: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and what the
    rules use beside: n_lines with words, n_stopped of them that end a sentence, n_upper
    (words in capitals), n_echoes (words equal to the one before), n_pauses (punctuation
    behind words), n_odd (characters in words that are no letters)."""
    text = F.coalesce(df["text"], F.lit(""))
    base = df.select(df["doc_id"].alias("doc_id"), text.alias("t"), F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "").alias("w"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(_BLANKS))) > 0)
    upper = F.size(F.filter("w", lambda x: (F.upper(x) == x) & (F.lower(x) != x)))
    base = base.select(
        "doc_id",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.translate("t", _BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", _SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.expr(_REPEATED).cast("bigint").alias("n_repeat_words"),
        lines.alias("lines"),
        upper.cast("bigint").alias("n_upper"),
        F.expr("size(filter(w, (x, i) -> i > 0 AND x = w[greatest(i - 1, 0)]))").cast("bigint").alias("n_echoes"),
        F.regexp_count("t", F.lit(r"[.,;:!?。，！？](?=[\x20\x09-\x0D]|$)")).cast("bigint").alias("n_pauses"),
        F.length(F.regexp_replace("t", r"[\p{L}\p{M}\x20\x09-\x0D]+", "")).cast("bigint").alias("n_odd"),
    )
    stopped = F.filter("lines", lambda x: F.substring(F.rtrim(x, F.lit(_BLANKS)), -1, 1).isin(*_STOPS))
    return base.select(
        "doc_id", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), "n_repeat_words",
        F.size("lines").cast("bigint").alias("n_lines"), F.size(stopped).cast("bigint").alias("n_stopped"), "n_upper", "n_echoes", "n_pauses", "n_odd",
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(-1)


def votes() -> dict[str, Column]:
    """The rules, as votes over the columns of ``counts``."""
    words, lines, chars = (F.greatest(c, F.lit(1)) for c in ("n_words", "n_lines", "word_chars"))
    mean, symbol, odd = F.col("word_chars") / words, F.col("n_symbols") / words, F.col("n_odd") / chars
    pause, echo, upper = F.col("n_pauses") / words, F.col("n_echoes") / words, F.col("n_upper") / words
    dup, stop = F.col("n_dup_lines") / lines, F.col("n_stopped") / lines
    return {
        "word_length": _vote(mean.between(3, 10), (mean < 2) | (mean > 15)),
        "symbols": _vote(symbol < 0.02, symbol > 0.1),
        "odd": _vote(odd < 0.08, odd > 0.15),
        "pauses": _vote(pause >= 0.06, pause < 0.03),
        "echoes": _vote(echo < 0.05, echo > 0.2),
        "stops": _vote(stop > 0.7, stop < 0.2),
        "lines": _vote((dup < 0.1) & (F.col("n_lines") > 1), (dup > 0.3) & (F.col("n_dup_lines") > 2)),
        "capitals": _vote(upper < 0.1, upper > 0.4),
    }


Votes = tuple[int, ...]


def _likelihoods(v: Votes, model: tuple[float, list]) -> tuple[float, float]:
    """Probability of these votes and a good text, and of these votes and a bad one."""
    prior, right = model
    a, b = prior, 1 - prior
    for x, (g, w) in zip(v, right):
        if x >= 0:
            a, b = a * (g if x else 1 - g), b * (1 - w if x else w)
    return a, b


def posterior(v: Votes, model: tuple[float, list]) -> float:
    a, b = _likelihoods(v, model)
    return a / (a + b)


def _climb(patterns: list[tuple[Votes, int]], p: dict[Votes, float], rounds: int) -> tuple[float, tuple[float, list]]:
    """EM from the probabilities p of good: (log likelihood, (share of good, of each rule
    the chances that it calls good good and bad bad))."""
    total = sum(n for _, n in patterns)
    for _ in range(rounds):
        prior = min(0.999, max(0.001, sum(p[v] * n for v, n in patterns) / total))
        right = []
        for j in range(len(patterns[0][0])):
            spoke = [(v[j], p[v] * n, (1 - p[v]) * n) for v, n in patterns if v[j] >= 0]
            good, bad = sum(a for _, a, _ in spoke), sum(b for _, _, b in spoke)
            g = (sum(a for x, a, _ in spoke if x == 1) + 0.9) / (good + 1)
            w = (sum(b for x, _, b in spoke if x == 0) + 0.5) / (bad + 1)
            right.append((g, min(0.999, max(w, 1 + ABOVE_CHANCE - g))))
        model = prior, right
        p = {v: posterior(v, model) for v, _ in patterns}
    return sum(n * math.log(sum(_likelihoods(v, model))) for v, n in patterns), model


def fit(patterns: list[tuple[Votes, int]], rounds: int = ROUNDS) -> tuple[float, list] | None:
    """The likeliest model of how often each combination of votes occurs; None if there
    is none.  Starts: any bad vote is suspect, two are, or most."""
    if not patterns:
        return None
    starts = [lambda v: 0 in v, lambda v: v.count(0) > 1, lambda v: v.count(0) > v.count(1)]
    ends = [_climb(patterns, {v: 0.05 if bad(v) else 0.95 for v, _ in patterns}, rounds) for bad in starts]
    return max(ends, key=lambda end: end[0])[1]


def judge(df: DataFrame) -> DataFrame:
    """The counts of each document with base_failed, kept and posterior; the posterior is
    null where no document passes the base limits."""
    rules = votes()
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    seen = cut(counts(df).withColumns({f"vote_{n}": c for n, c in rules.items()} | {"base_failed": failed}), "rules")
    names = [f"vote_{n}" for n in rules]
    got = seen.groupBy(*names).agg(F.count_if(~F.col("base_failed")).alias("n")).collect()  # at most 3**rules rows
    every = sorted((tuple(r[n] for n in names), r["n"]) for r in got)
    model = fit([(v, n) for v, n in every if n])
    table = seen.sparkSession.createDataFrame([(*v, posterior(v, model) if model else None) for v, _ in every], ", ".join(f"{n} int" for n in names) + ", posterior double")
    out = seen.join(F.broadcast(table), names)
    kept = ~F.col("base_failed") & F.coalesce(F.col("posterior") >= KEEP, F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "posterior")
