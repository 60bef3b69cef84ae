"""Quality rules: a threshold table compiled into one projection.

All figures of a text are built-in expressions over it and its array of
words, so a document is judged where it is read: no shuffle, no user function.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common words of the four languages.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on are this from he "
    "le la les de des un une et en que qui dans pour par sur est pas du au plus "
    "der die das und ist von zu den mit ein eine nicht im für auf sich dem es des als "
    "el los las y una del se no con su al lo como para"
).split()


@dataclass(frozen=True)
class Rule:
    """A figure of a text with the least and the greatest value that pass; None leaves that side open."""

    name: str
    figure: str
    least: float | None = None
    greatest: float | None = None

    def fails(self) -> str:
        sides = [f"{self.figure} < {self.least}"] * (self.least is not None) + [f"{self.figure} > {self.greatest}"] * (self.greatest is not None)
        return " or ".join(sides)


#: Figures are SQL over the columns that ``figures`` makes.
RULES: tuple[Rule, ...] = (
    Rule("words", "n_words", 50),
    Rule("repeated_windows", "100 * n_repeat_words - 50 * n_words", None, 0),
    Rule("word_length", "word_chars / n_words", 2, 16),
    Rule("symbols", "n_symbols / n_words", None, 0.3),
    Rule("stop_words", "n_stop_words", 2),
    Rule("exclamations", "n_exclamations / n_words", None, 0.3),
    Rule("upper_case", "n_upper / word_chars", None, 0.4),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", None, 0.5),
    Rule("bars", "n_bars / n_words", None, 0.2),
)

#: The rules of the base; the rest is the method's verdict.
BASE = ("words", "repeated_windows")

#: The columns that ``figures`` makes.
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_exclamations", "n_upper", "n_bars")

_SPACE = "' \t\n\v\f\r'"


def figures(docs: DataFrame, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """docs with the figures of its texts; columns of docs that bear a figure's name are replaced, all others stay.

    Words are runs of other characters than ASCII white space.  A null text
    has no words.  n_repeat_words counts the words that lie in a 3-word
    window found twice or more: windows are sorted by a 64-bit hash and their
    position, those of equal neighbours are compared word by word, and their
    places are joined to runs.  (A window counts if a neighbour in that order
    has its words; unlike windows of equal hash would have to fall between two
    like ones to hide them.)
    """
    clash = {c: f"{c}_of_docs" for c in docs.columns if c in ("_w", "_l", "_s", "_d", "_p")}
    docs = docs.withColumnsRenamed(clash)
    t = "coalesce(text, '')"
    bare = f"trim(BOTH {_SPACE} FROM {t})"
    docs = docs.withColumn("_w", F.expr(f"CASE WHEN {bare} = '' THEN array() ELSE split({bare}, '[ \\\\t-\\\\r]+') END"))
    docs = docs.withColumn("n_words", F.expr("cast(size(_w) as bigint)"))
    docs = docs.withColumn("_l", F.expr(f"filter(split({t}, '\\n'), x -> x rlike '[^ \\\\t-\\\\r]')"))
    docs = docs.withColumn(
        "_s",
        F.expr("CASE WHEN n_words < 4 THEN cast(array() as array<struct<h: bigint, i: int>>) ELSE sort_array(transform(slice(_w, 1, size(_w) - 2), (w, i) -> named_struct('h', xxhash64(w, get(_w, i + 1), get(_w, i + 2)), 'i', i))) END"),
    )
    alike = "x.h = get(_s, {k}).h AND slice(_w, x.i + 1, 3) = slice(_w, get(_s, {k}).i + 1, 3)"
    docs = docs.withColumn("_d", F.expr(f"filter(_s, (x, j) -> coalesce({alike.format(k='j - 1')}, false) or coalesce({alike.format(k='j + 1')}, false))"))
    docs = docs.withColumn("_p", F.expr("sort_array(transform(_d, x -> cast(x.i as bigint)))"))
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(stop_words))
    out = {
        "word_chars": "cast(length(array_join(_w, '')) as bigint)",
        "n_symbols": f"cast(length({t}) - length(regexp_replace({t}, '[#*$%&|<>]+', '')) as bigint)",
        "n_dup_lines": "cast(size(_l) - size(array_distinct(_l)) as bigint)",
        "n_repeat_words": "CASE WHEN size(_p) = 0 THEN 0L ELSE aggregate(transform(_p, (p, i) -> least(3L, coalesce(get(_p, i + 1) - p, 3L))), 0L, (s, x) -> s + x) END",
        "n_lines": "cast(size(_l) as bigint)",
        "n_stop_words": f"cast(size(array_intersect(_w, array({stops}))) as bigint)",
        "n_exclamations": f"cast(length({t}) - length(replace({t}, '!', '')) as bigint)",
        "n_upper": f"cast(length(regexp_replace({t}, '[^\\\\p{{Lu}}]+', '')) as bigint)",
        "n_bars": f"cast(length({t}) - length(replace({t}, '|', '')) as bigint)",
    }
    return docs.withColumns({k: F.expr(v) for k, v in out.items()}).drop("_w", "_l", "_s", "_d", "_p").withColumnsRenamed({v: k for k, v in clash.items()})


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[str] = BASE) -> DataFrame:
    """docs with the figures, ``base_failed``, ``failed`` (the names of the rules it fails) and ``kept``.

    A text without words fails the rule on words, and no other is asked of it.
    """
    out = figures(docs)
    fails = {r.name: F.expr(f"coalesce(n_words > 0 and ({r.fails()}), false)") if r.name != "words" else F.expr(r.fails()) for r in rules}
    failed = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in fails.items()]), lambda x: x.isNotNull())
    own = [c for n, c in fails.items() if n in base]
    out = out.withColumn("base_failed", own[0] if len(own) == 1 else F.greatest(*own)) if own else out.withColumn("base_failed", F.lit(False))
    out = out.withColumn("failed", failed).withColumn("kept", F.size("failed") == 0)
    # One generated row each: a filter on a verdict stays above it.  Pushed below the figures, it would
    # spell each of them out again within the next, down to the split of the text within every lambda.
    made = [*FIGURES, "base_failed", "failed", "kept"]
    rest = [c for c in out.columns if c not in made]
    return out.select(*rest, F.inline(F.array(F.struct(*made))))
