"""Quality rules, line first: drop failing lines, then documents that lost too much.

Each line of a document is judged alone:

* navigation: separators (``|``, bullets, arrows) stand for at least a third of its words, or it is a
  short list of site words (home, login, ...);
* punctuation: symbol characters ``#*$%&|<>`` are at least one per two words, or a line of
  ``long_line`` or more words has no sentence punctuation at all;
* boilerplate: a line of fewer than ``long_line`` words speaks of cookies, scripts, subscriptions or all rights reserved,
  in English, German, French or Spanish; a longer line is prose that may mention them;
* repetition: a line of ``long_line`` or more words with fewer than a third distinct.

Failing lines are removed. A document is rejected if the removed words are more
than ``max_lost`` of its words or fewer than ``min_words`` remain. Lines of
ordinary prose fail no rule, so clean documents pass unchanged.

The document counts (:func:`measures`) are exact per text: word characters,
symbols, repeated lines and words in repeated 5-word windows.

Everything is a projection over built-in functions: no shuffle, no Python.
Windows are compared by 64-bit hashes of their words; only texts that hold a
repeated window sort their window hashes.

Defined cases: a null text counts as empty; an empty text has no words and is
rejected; an empty table gives an empty result; columns named like the outputs
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulyst.llm.common import SPACE, let

SYMBOLS = "#*$%&|<>"
#: Words per window of the repetition count.
WINDOW = 5
NAVIGATION = (r"(?i)^(\W*(home|about|contact|login|log in|sign in|sign up|register|menu|search|next|previous|back|top|share|print|sitemap|help|faq|"
              r"impressum|datenschutz|startseite|kontakt|anmelden|suche|accueil|connexion|rechercher|inicio|contacto|buscar|aviso legal)\b\W*)+$")
BOILERPLATE = (r"(?i)\b(cookies? (policy|settings|preferences)|(use|uses|accept( all)?) cookies|enable javascript|javascript (is )?(required|disabled)|"
               r"all rights reserved|terms (of (use|service)|and conditions)|privacy policy|subscribe to (our|the)|sign up for our|click here to|"
               r"alle rechte vorbehalten|tous droits r.serv.s|todos los derechos reservados|(verwendet|verwenden|nutzt|nutzen|akzeptieren) cookies|"
               r"cookies (akzeptieren|zulassen)|(utilise|utilisons|accepter|acceptez) (des|les|tous les) cookies|(utiliza|utilizamos) cookies|aceptar (las |todas las )?cookies)\b")
SENTENCE_END = r"[.!?…。！？:;,]"


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def words(text: Column) -> Column:
    """The words of a text, in order."""
    plain = F.translate(text, SPACE, " " * len(SPACE))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def repeated_words(word_list: Column) -> Column:
    """Number of words inside windows of WINDOW words that stand twice or more in the list."""
    n = F.size(word_list)

    def count(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return let(windows, covered)

    def covered(ws: Column) -> Column:
        return F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), lambda s: let(places(s), spread)))

    def places(s: Column) -> Column:
        """Start positions, ascending, of windows that have an equal."""
        same = F.filter(s, lambda x, i: (F.get(s, i - 1)["w"] == x["w"]).eqNullSafe(F.lit(True))
                        | (F.get(s, i + 1)["w"] == x["w"]).eqNullSafe(F.lit(True)))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def spread(at: Column) -> Column:
        gaps = F.transform(at, lambda a, i: F.least(F.coalesce(F.get(at, i + 1) - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda x, y: x + y)

    return F.when(n < WINDOW, F.lit(0)).otherwise(let(F.transform(word_list, lambda w: F.xxhash64(w)), count)).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """Exact counts of one text (null: empty)."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: without(x, SPACE) != "")
    word_list = words(text)
    return {
        "n_words": let(word_list, lambda w: F.size(w)).cast("long"),
        "word_chars": F.length(without(text, SPACE)).cast("long"),
        "n_symbols": (F.length(text) - F.length(without(text, SYMBOLS))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": let(word_list, repeated_words).cast("long"),
    }


def line_fails(line: Column, word_list: Column, long_line: int) -> Column:
    """Whether one line fails a rule; ``word_list`` are the line's words."""
    n_words = F.size(word_list)
    symbols = F.length(line) - F.length(without(line, SYMBOLS))
    separators = F.length(line) - F.length(without(line, "|•·»›→"))
    distinct = F.size(F.array_distinct(word_list))
    return (
        (separators * 3 >= n_words) & (separators > 0)
        | (symbols * 2 >= n_words) & (symbols > 1)
        | (n_words <= 12) & line.rlike(NAVIGATION)
        | (n_words < long_line) & line.rlike(BOILERPLATE)
        | (n_words >= long_line) & ~line.rlike(SENTENCE_END)
        | (n_words >= long_line) & (distinct * 3 < n_words)
    )


def clean(df: DataFrame, text: str = "text", max_lost: float = 0.3, min_words: int = 10, long_line: int = 25) -> DataFrame:
    """``df`` with ``clean_text`` (kept lines), ``n_words``, ``lost_words`` and ``lines_kept`` (boolean verdict).

    Blank lines stay. ``lines_kept`` is false where more than ``max_lost`` of
    the words stood in failing lines, or fewer than ``min_words`` are left.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    judged = F.transform(F.split(body, "\n"), lambda x: let(words(x), lambda ws: F.struct(
        x.alias("line"), F.size(ws).alias("n"), ((F.size(ws) > 0) & line_fails(x, ws, long_line)).alias("bad"))))
    result = let(judged, lambda ls: F.struct(
        F.array_join(F.transform(F.filter(ls, lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("text"),
        F.aggregate(ls, F.lit(0), lambda a, x: a + x["n"]).alias("words"),
        F.aggregate(ls, F.lit(0), lambda a, x: a + F.when(x["bad"], x["n"]).otherwise(0)).alias("lost")))
    out = df.drop("clean_text", "n_words", "lost_words", "lines_kept").withColumn("__r", result)
    out = out.withColumns({"clean_text": F.col("__r.text"), "n_words": F.col("__r.words").cast("long"), "lost_words": F.col("__r.lost").cast("long")})
    kept = (F.col("lost_words") <= F.lit(max_lost) * F.col("n_words")) & (F.col("n_words") - F.col("lost_words") >= min_words)
    return out.withColumn("lines_kept", kept).drop("__r")
