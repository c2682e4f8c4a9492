"""Distribution divergence: how far a text's make-up lies from that of prose.

Two histograms of the whole text are compared with a reference for each language by the
Jensen-Shannon distance (the root of the divergence in bits, 0 to 1): shares of six
character classes, and shares of the language's ten most common words. The closest
language counts, so a wrong language tag costs nothing. A histogram of a short text says little:
below `min_chars` characters or `min_words` words its distance is not used.

The references given here were measured with `measured` over the documents of quality 1 of the test
table of scale 0.1, which hold English, German, French and Spanish prose. A long text in any
other language is far from all of them and is rejected; for more languages or other prose, measure
a clean sample of it and pass the result on.

Built of SQL functions alone, row by row: no shuffle, no Python, whole texts.

Defined cases: a null or empty text has no words, fails the base rule and has null
distances; null ids stay; repeated rows are judged each on its own; a very long text is
counted whole; an empty table gives no rows; columns other than the id and the text are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD

GAP = r"[\x20\x09-\x0D]+"
#: Classes in the order of CHARACTER_SHARES; what is in none of the first five is a symbol.
CLASSES = ("lower", "upper", "digit", "space", "mark", "symbol")
#: Fixed reference values: shares of the classes in clean prose.
CHARACTER_SHARES = {
    "en": (0.79525, 0.0138, 0.00054, 0.16673, 0.02366, 0.00002),
    "de": (0.81041, 0.01279, 0.00039, 0.15464, 0.02176, 0.00001),
    "fr": (0.79465, 0.014, 0.00078, 0.1667, 0.02383, 0.00004),
    "es": (0.80118, 0.01345, 0.00073, 0.16167, 0.02296, 0.00001),
}
#: Fixed reference values: the ten most common words and their shares of all words.
WORD_SHARES = {
    "en": {"the": 0.0629, "of": 0.0365, "and": 0.0264, "to": 0.02, "a": 0.0158, "in": 0.0139, "is": 0.0117, "that": 0.0106, "it": 0.0094, "for": 0.0085},
    "de": {"der": 0.0622, "die": 0.0366, "und": 0.0262, "in": 0.02, "den": 0.0162, "von": 0.0136, "zu": 0.0111, "das": 0.0109, "mit": 0.0093, "sich": 0.0084},
    "fr": {"de": 0.0625, "la": 0.0378, "le": 0.0253, "et": 0.0207, "les": 0.0164, "des": 0.0139, "en": 0.0125, "un": 0.0108, "du": 0.0091, "une": 0.008},
    "es": {"de": 0.0623, "la": 0.0364, "que": 0.0256, "el": 0.0199, "en": 0.0163, "y": 0.0137, "los": 0.0117, "se": 0.0103, "las": 0.0095, "del": 0.0092},
}


def without(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, ""))


def add_counts(df: DataFrame, text: str) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, beside `text`."""
    t = F.col(text)
    df = df.withColumn("words_", F.array_remove(F.split(t, GAP, -1), ""))
    df = df.withColumn("lines_", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)))
    n = F.size("words_")
    w = lambda i: F.get(F.col("words_"), i)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(w(i), w(i + 1), w(i + 2)).alias("h"), i.alias("p")))
    df = df.withColumn("sorted_", F.when(n >= 3, F.sort_array(windows)).otherwise(F.array().cast("array<struct<h:bigint,p:int>>")))
    same = lambda x, i: x["h"].eqNullSafe(F.get(F.col("sorted_"), i)["h"])
    again = F.filter("sorted_", lambda x, i: same(x, i - 1) | same(x, i + 1))
    df = df.withColumn("starts_", F.sort_array(F.transform(again, lambda x: x["p"])))
    # A window at p covers p to p + 2; what the next one covers too counts once.
    fresh = F.transform("starts_", lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col("starts_"), i + 1) - p, F.lit(3))))
    return df.select(
        *[c for c in df.columns if c not in ("words_", "lines_", "sorted_", "starts_")],
        n.cast("long").alias("n_words"),
        without(t, GAP).cast("long").alias("word_chars"),
        without(t, r"[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        F.aggregate(fresh, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
    )


def js_distance(have: Column, want: list[float]) -> Column:
    """have: an array of shares, in the order of `want`."""

    def term(p: Column, q: Column) -> Column:
        mean = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / mean)).otherwise(0.0) + q * F.log2(q / mean)

    terms = F.zip_with(have, F.array(*map(F.lit, want)), term)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def add_distances(df: DataFrame, text: str, min_chars: int, min_words: int, characters: dict = CHARACTER_SHARES, words: dict = WORD_SHARES) -> DataFrame:
    """char_distance and word_distance to the closest language, null below the guards."""
    t = F.col(text)
    total = F.char_length(t)
    marks = without(t, r"[^.,;:!?()'\"-]+")
    df = df.withColumn("class_", F.array(without(t, r"[^\p{Ll}]+"), without(t, r"[^\p{Lu}]+"), without(t, r"[^0-9]+"), total - F.col("word_chars"), marks))
    # What is left of the letter runs once long ones are gone: no listed word is long. Two
    # spaces part them, so that one word's hits never overlap.
    longest = max(len(w) for own in words.values() for w in own)
    short = F.regexp_replace(F.lower(t), rf"[^\p{{L}}]*+\p{{L}}{{{longest + 1},}}[^\p{{L}}]*|[^\p{{L}}]+", "  ")
    df = df.withColumn("spaced_", F.concat(F.lit(" "), short, F.lit(" ")))
    names = sorted({w for own in words.values() for w in own})
    hits = [((F.char_length("spaced_") - F.char_length(F.replace(F.col("spaced_"), F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).alias(w) for w in names]
    df = df.withColumn("hits_", F.struct(*hits)).drop("spaced_")
    total_of = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
    chars = F.transform("class_", lambda x: x / F.nullif(total, F.lit(0)))
    symbol = (total - F.aggregate("class_", F.lit(0).cast("long"), lambda a, x: a + x)) / F.nullif(total, F.lit(0))
    df = df.withColumn("chars_", F.concat(chars, F.array(symbol)))
    of = lambda w: F.least(F.lit(1.0), F.col("hits_")[w] / F.nullif(F.col("n_words"), F.lit(0)))
    df = df.withColumns({f"{code}_": F.array(*map(of, own)) for code, own in words.items()})
    df = df.withColumns({f"{code}_": F.concat(f"{code}_", F.array(F.greatest(F.lit(0.0), 1 - total_of(F.col(f"{code}_"))))) for code in words})
    df = df.withColumns({f"{code}_": js_distance(F.col(f"{code}_"), [*own.values(), 1 - sum(own.values())]) for code, own in words.items()})
    df = df.withColumns({f"char_{code}_": js_distance(F.col("chars_"), list(v)) for code, v in characters.items()})
    least = lambda names: F.array_min(F.array(*names))
    nearest = {"char_distance": F.when(total >= min_chars, least([f"char_{c}_" for c in characters])), "word_distance": F.when(F.col("n_words") >= min_words, least([f"{c}_" for c in words]))}
    return df.withColumns(nearest).drop("class_", "hits_", "chars_", *[f"{c}_" for c in words], *[f"char_{c}_" for c in characters])


def judge(docs: DataFrame, max_char_distance: float = 0.22, max_word_distance: float = 0.29, min_chars: int = 200, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", characters: dict = CHARACTER_SHARES, words: dict = WORD_SHARES) -> DataFrame:
    """doc_id, the counts, base_failed, kept, char_distance, word_distance per document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    rows = add_distances(add_counts(rows, "text_"), "text_", min_chars, min_words, characters, words).drop("text_")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = F.coalesce(F.col("char_distance") > max_char_distance, F.lit(False)) | F.coalesce(F.col("word_distance") > max_word_distance, F.lit(False))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~far).alias("kept"), "char_distance", "word_distance")


def sql(max_char_distance: float = 0.22, max_word_distance: float = 0.29, min_chars: int = 200, min_words: int = 50) -> str:
    """The same rows in DuckDB's SQL, without the distances."""

    def js(have: list[str], want: list[float]) -> str:
        terms = [f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q!r}) / 2)) ELSE 0 END + {q!r}::DOUBLE * log2({q!r}::DOUBLE / (({p} + {q!r}) / 2)))" for p, q in zip(have, want, strict=True)]
        return f"sqrt(greatest(0.0, ({' + '.join(terms)}) / 2))"

    names = sorted({w for words in WORD_SHARES.values() for w in words})
    kept = {"lower": r"[^\p{Ll}]+", "upper": r"[^\p{Lu}]+", "digit": "[^0-9]+", "mark": r"[^.,;:!?()''\"-]+"}
    chars = [js([f"s_{c}" for c in CLASSES], list(v)) for v in CHARACTER_SHARES.values()]
    words = [js([*(f"h_{w}" for w in v), f"greatest(0.0, 1 - ({' + '.join(f'h_{w}' for w in v)}))"], [*v.values(), 1 - sum(v.values())]) for v in WORD_SHARES.values()]
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM a WHERE len(w) >= 3),
r AS (SELECT rid, p FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n >= 2),
c AS (SELECT rid, sum(least(3, coalesce(nxt - p, 3)))::BIGINT AS n_repeat_words FROM (SELECT *, lead(p) OVER (PARTITION BY rid ORDER BY p) AS nxt FROM r) GROUP BY rid),
b AS (SELECT a.rid, doc_id, t, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{GAP}', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, length(t)::DOUBLE AS total,
        ' ' || regexp_replace(lower(t), '[^\p{{L}}]+', '  ', 'g') || ' ' AS sp FROM a LEFT JOIN c ON a.rid = c.rid),
s AS (SELECT *, {', '.join(f"length(regexp_replace(t, '{p}', '', 'g')) / total AS s_{c}" for c, p in kept.items())}, (total - word_chars) / total AS s_space,
        {', '.join(f"least(1.0, (length(sp) - length(replace(sp, ' {w} ', ''))) / {len(w) + 2} / n_words) AS h_{w}" for w in names)} FROM b),
f AS (SELECT *, (total - total * (s_lower + s_upper + s_digit + s_space + s_mark)) / total AS s_symbol FROM s),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        coalesce(total >= {min_chars} AND least({', '.join(chars)}) > {max_char_distance!r}, false) OR coalesce(n_words >= {min_words} AND least({', '.join(words)}) > {max_word_distance!r}, false) AS far FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT far AS kept FROM j
"""


def measured(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", n_words: int = 10) -> tuple[dict, dict]:
    """The references (characters, words) of clean documents by their language: a row a language
    and word comes to the driver, n_words of each."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t")).where("lang IS NOT NULL AND t IS NOT NULL")
    gone = {"lower": r"[^\p{Ll}]+", "upper": r"[^\p{Lu}]+", "digit": "[^0-9]+", "mark": r"[^.,;:!?()'\"-]+"}
    sums = rows.groupBy("lang").agg(
        F.sum(F.char_length("t")).alias("all"), F.sum(F.char_length("t") - without(F.col("t"), GAP)).alias("space"), *[F.sum(without(F.col("t"), p)).alias(c) for c, p in gone.items()],
        F.sum(F.regexp_count("t", F.lit(WORD))).alias("n"),
    )
    characters, totals = {}, {}
    for r in sums.where("all > 0 AND n > 0").collect():
        shares = {c: r[c] / r["all"] for c in CLASSES[:-1]}
        # No share is 0: a class that the sample lacks would be infinitely far off.
        characters[r["lang"]] = tuple(max(1e-5, x) for x in (*shares.values(), 1 - sum(shares.values())))
        totals[r["lang"]] = r["n"]
    each = rows.select("lang", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"(\p{L}+)"), 1)).alias("word")).groupBy("lang", "word").count()
    top = each.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("count"), "word"))).where(F.col("place") <= n_words)
    words: dict = {}
    for r in top.orderBy("lang", "place").collect():
        if r["lang"] in totals:
            words.setdefault(r["lang"], {})[r["word"]] = r["count"] / totals[r["lang"]]
    return characters, words
