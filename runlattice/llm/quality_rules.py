"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Measures are plain column expressions over the whole text; a rule compares one measure with a
share of another in whole numbers, so every engine gets the same verdict.  Null text counts as
no words (and fails ``min_words``); repeated rows are judged row by row; extra columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlattice.llm.common import table, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Frequent function words of the four languages (fixed values).
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "on", "with", "be", "by", "this", "are",
    "der", "die", "das", "und", "ist", "von", "zu", "den", "mit", "für", "ein", "auf", "nicht", "des",
    "le", "la", "les", "de", "et", "un", "une", "que", "qui", "dans", "pour", "par", "sur", "est", "du", "en",
    "el", "los", "las", "y", "que", "por", "con", "para", "se", "una", "del", "no", "es", "al",
)


@dataclass(frozen=True)
class Rule:
    """Fails when ``100 * measure`` is above (``above``) or below ``percent * base`` (``base`` None: 1)."""

    name: str
    measure: str
    percent: int
    base: str | None = None
    above: bool = True
    is_base: bool = False

    def fails(self, m: dict[str, Column]) -> Column:
        bound = F.lit(self.percent).cast("long") * (m[self.base] if self.base else F.lit(1).cast("long"))
        value = m[self.measure] * F.lit(100).cast("long")
        return value > bound if self.above else value < bound


RULES = (
    Rule("min_words", "n_words", 2000, above=False, is_base=True),
    Rule("repeated_words", "n_repeat_words", 30, "n_words", is_base=True),
    Rule("short_words", "word_chars", 200, "n_words", above=False),
    Rule("long_words", "word_chars", 1500, "n_words"),
    Rule("symbols", "n_symbols", 25, "n_words"),
    Rule("stop_words", "n_stop_kinds", 200, above=False),
    Rule("dup_lines", "n_dup_lines", 50, "n_lines"),
)


def _let(value: Column, body) -> Column:
    """``body`` over a once-computed value: a lambda variable, so that nothing is computed again per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(ws: Column) -> Column:
    """Words inside windows of WINDOW words that occur at least twice in the text."""

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            near = lambda k: F.try_element_at(s, k)["h"]
            hit = F.filter(
                s,
                lambda x, k: F.coalesce(x["h"] == near(k + 2), F.lit(False))
                | ((k > 0) & F.coalesce(x["h"] == near(F.greatest(k, F.lit(1))), F.lit(False))),
            )
            return F.array_sort(F.transform(hit, lambda x: x["i"]))

        def total(p: Column) -> Column:
            step = F.transform(
                p, lambda x, k: F.least(F.coalesce(F.try_element_at(p, k + 2) - x, F.lit(WINDOW)), F.lit(WINDOW))
            )
            return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

        return _let(_let(pairs, starts), total)

    def of(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
        )
        some = F.when(F.size(w) >= WINDOW, windows).otherwise(F.array().cast("array<bigint>"))
        return _let(
            some,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)),
        )

    return _let(F.transform(ws, lambda x: F.xxhash64(x)), of)


def measures(text: Column) -> dict[str, Column]:
    """The measure columns of a text, all long."""
    t = F.coalesce(text, F.lit(""))
    long = lambda c: c.cast("long")
    bare = F.translate(t, " \t\n\x0b\f\r", "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    stops = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    return {
        "n_words": long(F.size(words(text))),
        "word_chars": long(F.length(bare)),
        "n_symbols": long(F.length(t) - F.length(F.translate(t, SYMBOLS, ""))),
        "n_lines": long(F.size(lines)),
        "n_dup_lines": long(_let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))),
        "n_repeat_words": _repeat_words(words(text)),
        "n_stop_kinds": long(F.size(F.array_intersect(words(F.lower(text)), stops))),
    }


def judge(docs: DataFrame, text: str = "text", rules=RULES, prefix: str = "") -> DataFrame:
    """``docs`` with the measures, ``base_failed``, the names of failed rules and ``kept``.

    New columns get ``prefix``; where a column of that name is there already, it is replaced.
    """
    m = measures(F.col(text))
    rest = docs.drop(*[f"{prefix}{k}" for k in m])
    # a generator, unlike a projection, isn't merged with what reads it: each measure is computed once
    out = docs.select(
        *[docs[c] for c in rest.columns], F.inline(F.array(F.struct(*[v.alias(f"{prefix}{k}") for k, v in m.items()])))
    )
    have = {k: F.col(f"{prefix}{k}") for k in m}
    base = F.lit(False)
    for rule in rules:
        if rule.is_base:
            base = base | rule.fails(have)
    failed = F.filter(
        F.array(*[F.when(r.fails(have), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull()
    )
    return out.withColumns(
        {f"{prefix}base_failed": base, f"{prefix}failed_rules": failed, f"{prefix}kept": F.size(failed) == 0}
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_W = r"[^\x20\x09-\x0D]+"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '{_W}') AS ws FROM d),
win AS (SELECT k, unnest(range(1, len(ws) - {WINDOW - 2})) AS i, ws FROM w WHERE len(ws) >= {WINDOW}),
ws2 AS (SELECT k, i, array_to_string(ws[i:i+{WINDOW - 1}], ' ') AS g FROM win),
dup AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM ws2) WHERE c > 1),
gap AS (SELECT k, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY k ORDER BY i) - i, {WINDOW})) AS n FROM dup),
rep AS (SELECT k, CAST(sum(n) AS BIGINT) AS n_repeat_words FROM gap GROUP BY k),
m AS (SELECT w.k, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
   CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
   CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
   coalesce(n_repeat_words, 0) AS n_repeat_words,
   CAST(len(list_intersect(list_transform(ws, lambda x: lower(x)), [{", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))}])) AS BIGINT) AS stops
 FROM w LEFT JOIN rep ON rep.k = w.k),
n AS (SELECT *, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
   n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words AND 100 * n_symbols <= 25 * n_words
  AND stops >= 2 AND 100 * n_dup_lines <= 50 * len(ls) AS kept
FROM n
"""
