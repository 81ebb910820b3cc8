"""Column functions over corpus, query and answer text. Built-in expressions only."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill import constants as K
from lexmill.functions.binding import any_of, let

WORD_EDGE = rf"(?:(?<=[{K.WORD}])(?![{K.WORD}])|(?<![{K.WORD}])(?=[{K.WORD}]))"
BLANKS = r"[ \t\x1F\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
TOKEN_PATTERN = rf"[\x{{0600}}-\x{{06FF}}{K.WORD}]{{2,}}"


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def strip(col: Column) -> Column:
    """Trim every Unicode white-space character from both ends."""
    return F.trim(col, F.lit(K.WS_CHARS))


def western_digits(col: Column) -> Column:
    return F.translate(text_or_empty(col), K.ARABIC_DIGITS, K.WESTERN_DIGITS)


def _fold_letters(col: Column, teh_marbuta: bool, spaces: bool = False) -> Column:
    """One ``translate`` for every letter, digit and, when asked, white-space rule."""
    blank = K.WS_CHARS.replace(" ", "") if spaces else ""
    source = K.ALEF_FORMS + "ى" + ("ة" if teh_marbuta else "") + K.ARABIC_DIGITS + blank
    target = "ا" * len(K.ALEF_FORMS) + "ي" + ("ه" if teh_marbuta else "") + K.WESTERN_DIGITS + " " * len(blank)
    return F.translate(text_or_empty(col), source + K.TATWEEL + K.DIACRITICS, target)


def normalize(col: Column, teh_marbuta: bool = False) -> Column:
    """Search form: no tatweel or diacritics, unified alef and yaa, western digits, single spaces."""
    return F.trim(F.regexp_replace(_fold_letters(col, teh_marbuta, spaces=True), " {2,}", " "))


def normalize_literal(text: str, teh_marbuta: bool = False) -> str:
    """The same folding for word lists held on the driver."""
    pairs = {c: "ا" for c in K.ALEF_FORMS} | {"ى": "ي"} | dict(zip(K.ARABIC_DIGITS, K.WESTERN_DIGITS))
    if teh_marbuta:
        pairs["ة"] = "ه"
    drop = set(K.TATWEEL + K.DIACRITICS)
    return " ".join("".join(pairs.get(c, c) for c in text if c not in drop).split())


def clean_raw(col: Column) -> Column:
    """Readable text without extraction artefacts; at most one blank line in a row."""
    text = F.regexp_replace(text_or_empty(col), r"[\x{E000}-\x{F8FF}]", "")
    text = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    breaks = "\x0b\f\r\x1c\x1d\x1e\x85\u2028\u2029"
    quotes, plain = "«»”“’‘", '""""' + "''"
    text = F.translate(text, "\u00a0\t" + breaks + quotes + "\u200b", "  " + "\n" * len(breaks) + plain)
    text = F.regexp_replace(text, rf"(?:^|[{K.WS}])[\x{{064B}}-\x{{064D}}](?:[{K.WS}]|$)", " ")
    text = F.regexp_replace(text, " {2,}", " ")
    text = F.regexp_replace(text, rf"{BLANKS}*\n{BLANKS}*", "\n")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def marker_number(col: Column, max_article: int = K.MAX_ARTICLE) -> Column:
    """Number in an article marker; a value whose reversed digits alone are in range is repaired."""
    digits = F.array_join(F.regexp_extract_all(western_digits(col), F.lit("[0-9]+"), F.lit(0)), "")
    value = digits.try_cast("bigint")
    flipped = F.reverse(digits).try_cast("bigint")
    return F.when(flipped.between(1, max_article) & ~value.between(1, max_article), flipped).otherwise(value)


def _numbers(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.transform(found, lambda n: F.coalesce(n.try_cast("bigint"), F.lit(2**63 - 1)))


def _numbers_inside(text: Column, pattern: str) -> Column:
    """Every number, in western or Arabic digits, inside the matches: one scan of a text that has digits at all."""
    digit = f"[0-9{K.ARABIC_DIGITS[0]}-{K.ARABIC_DIGITS[-1]}]"
    found = F.regexp_extract_all(text, F.lit(pattern.replace("[0-9]", digit)), F.lit(0))
    found = F.when(text.rlike(digit), found).otherwise(F.array().cast("array<string>"))
    digits = F.flatten(F.transform(found, lambda m: F.regexp_extract_all(western_digits(m), F.lit("[0-9]+"), F.lit(0))))
    return F.transform(digits, lambda n: n.try_cast("int"))


def references(
    text_ar: Column,
    text_en: Column | None = None,
    current: Column | None = None,
    max_article: int = K.MAX_ARTICLE,
    strict: bool = False,
) -> Column:
    """Sorted distinct article numbers cross-referenced in Arabic and English text."""
    english = F.lit("") if text_en is None else text_en
    pattern = K.REFERENCE_AR_STRICT_PATTERN if strict else K.REFERENCE_AR_PATTERN
    found = F.concat(_numbers_inside(text_ar, pattern), _numbers_inside(english, K.REFERENCE_EN_PATTERN))
    own = F.lit(None).cast("int") if current is None else current
    keep = F.filter(found, lambda n: n.between(1, max_article) & ~n.eqNullSafe(own))
    return F.array_sort(F.array_distinct(keep))


def reference_edges(articles: DataFrame) -> DataFrame:
    """Adjacency lists as an edge table."""
    return articles.select(
        F.col("article_number").alias("src"), F.explode("references").alias("dst")
    )


def is_arabic(text: Column, mode: Column | str = "auto") -> Column:
    """True when Arabic letters are at least as many as Latin ones; an explicit mode overrides."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    arabic = F.regexp_count(text, F.lit(r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]"))
    latin = F.regexp_count(text, F.lit("[a-zA-Z]"))
    return F.when(mode == "ar", True).when(mode == "auto", arabic >= latin).otherwise(False)


def stem(word: Column) -> Column:
    """Light stemmer for normalized words: article, conjunction, preposition, article again.

    Each prefix goes only from a word of more than four letters; the look-aheads say so. Words that begin with none of
    their letters stay as they are.
    """
    prefixes = r"^(?:ال(?=.{3}))?(?:[وف](?=.{4}))?(?:[بلك](?=.{4}))?(?:ال(?=.{3}))?"
    return F.when(F.substring(word, 1, 1).isin(*"اوفبلك"), F.regexp_replace(word, prefixes, "")).otherwise(word)


def kept_words(
    text: Column,
    stopwords: list[str] = K.STOPWORDS,
    normalize_stopwords: bool = False,
    lowercase: bool = False,
) -> Column:
    """Normalized words of two or more characters that are not stopwords, before stemming.

    Letters are folded on the whole text: deletions never join or split runs, so this equals
    folding each word. The stop list is compared as given; it holds some unfolded forms.
    """
    folded = _fold_letters(text, True)
    words = F.regexp_extract_all(F.lower(folded) if lowercase else folded, F.lit(TOKEN_PATTERN), F.lit(0))
    stop = [normalize_literal(s, True) for s in stopwords] if normalize_stopwords else stopwords
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def tokens(text: Column, **options) -> Column:
    """Retrieval tokens: kept words, stemmed, in text order."""
    return F.transform(kept_words(text, **options), stem)


def expand_query(query: Column, synonyms: list[tuple[str, str]] = K.SYNONYMS) -> Column:
    """Append the synonyms of every concept contained in the normalized query, in list order."""
    folded = normalize(query, True)
    added = [
        F.when(folded.contains(normalize_literal(term, True)), F.lit(extra)) for term, extra in synonyms
    ]
    return F.concat_ws(" ", query, *added)


def expand_query_table(queries: DataFrame, synonyms: DataFrame, gram: int = 3) -> DataFrame:
    """Query expansion against a synonym table ``(ord, term, syns)`` of any size.

    Substring containment as an equi join: a term can only be contained where its first
    ``gram`` characters occur, so both sides are keyed by leading grams and then verified.
    """
    q = queries.withColumn("q_norm", normalize(F.col("question"), True))
    s = synonyms.select("ord", "syns", normalize(F.col("term"), True).alias("term_norm")).filter(
        F.length("term_norm") > 0
    )
    s = s.withColumn("gram", F.substring("term_norm", 1, gram))
    grams = F.array_distinct(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.length("q_norm")),
                lambda i: F.transform(
                    F.sequence(F.lit(1), F.lit(gram)), lambda n: F.substring(F.col("q_norm"), i, n)
                ),
            )
        )
    )
    hits = (
        q.filter(F.length("q_norm") > 0)
        .select("query_id", "q_norm", F.explode(grams).alias("gram"))
        .join(s, "gram")
        .filter(F.col("q_norm").contains(F.col("term_norm")))
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "syns"))).alias("hits"))
    )
    return (
        queries.join(hits, "query_id", "left")
        .withColumn("expanded", F.concat_ws(" ", "question", F.col("hits.syns")))
        .drop("hits")
    )


def detect_filters(
    query: Column,
    keywords: list[str] = K.REPEALED_KEYWORDS,
    repealed: list[tuple[int, int]] = K.REPEALED_RANGES,
) -> Column:
    """Struct with the explicit article numbers and whether repealed rows are excluded."""
    asks = F.lower(western_digits(query)).rlike(any_of(keywords))

    def build(numbers: Column) -> Column:
        in_range = F.exists(numbers, lambda n: in_ranges(n, repealed))
        return F.struct(
            F.lit(None).cast("string").alias("book"),
            F.lit(None).cast("string").alias("chapter"),
            F.lit(None).cast("string").alias("section"),
            (~(asks | in_range)).alias("exclude_repealed"),
            F.when(F.size(numbers) > 0, numbers).alias("article_numbers"),
        )

    return let(references(query, query), build)


def in_ranges(number: Column, ranges: list[tuple[int, int]]) -> Column:
    return reduce(lambda a, b: a | b, [number.between(lo, hi) for lo, hi in ranges], F.lit(False))


def paragraphs(text: Column) -> Column:
    """Split at numbered markers that open a line, else at blank lines, else keep the whole text."""
    digits = "0-9٠-٩"
    marker = rf"(?:^|\n)(?=(?:[\(\[][{K.WS}]*[{digits}]+[{K.WS}]*[\)\]]|[{digits}]+[{K.WS}.\-]))"

    def pieces(pattern: str) -> Column:
        return F.filter(F.transform(F.split(text, pattern), strip), lambda p: F.length(p) > 0)

    def or_else(parts: Column, other: Column) -> Column:
        return let(parts, lambda p: F.when(F.size(p) > 1, p).otherwise(other))

    return or_else(pieces(marker), or_else(pieces("\n\n"), F.array(strip(text))))


def embedding_text(mode: str, normalized: Column, english: Column, prefix: str = "") -> Column:
    """Text handed to the embedder: Arabic, English or both, with an optional model prefix."""
    if mode == "en":
        body = strip(english)
    elif mode == "ar+en":
        body = strip(F.concat(normalized, F.lit("\n"), english))
    else:
        body = strip(normalized)
    return F.concat(F.lit(prefix), body) if prefix else body


def cited_numbers(text: Column) -> Column:
    """Bracketed article citations; plain mentions only when there are none.

    Numbers are long integers. More digits than these hold can name no article: the largest long stands for them.
    """
    western = western_digits(text)
    plain = rf"(?i){WORD_EDGE}(?:المادة|Article)[{K.WS}]*([0-9]+){WORD_EDGE}"
    found = let(
        _numbers(western, K.CITED_BRACKET_PATTERN, 1),
        lambda bracketed: F.when(F.size(bracketed) > 0, bracketed).otherwise(_numbers(western, plain, 1)),
    )
    return F.array_sort(F.array_distinct(found))


def is_refusal(answer: Column, mark_ar: str = K.REFUSAL_MARK_AR, mark_en: str = K.REFUSAL_MARK_EN) -> Column:
    return answer.contains(mark_ar) | F.lower(answer).contains(mark_en)


def endpoint_template(path: Column) -> Column:
    """Collapse per-article paths to one label."""
    return F.when(path.startswith("/articles/"), F.lit("/articles/{number}")).otherwise(path)


def fixed_decimals(value: Column, digits: int) -> Column:
    """Number with fixed decimals; exact binary halves go to the even digit, as in C and Python.

    ``format_string`` alone rounds every half up. A half is exact when it has few binary digits.
    """
    scaled = value * float(2 ** (digits + 1))
    even = F.when(scaled == F.floor(scaled), F.bround(value, digits)).otherwise(value)
    return F.format_string(f"%.{digits}f", even)


def two_decimals(value: Column) -> Column:
    """Two decimals of a share in [0, 1], exact at every half: those are listed."""
    halves = [(2 * k + 1) / 200 for k in range(100)]
    listed = F.create_map(*[F.lit(v) for h in halves for v in (h, f"{h:.2f}")])
    return F.coalesce(F.try_element_at(listed, value), F.format_string("%.2f", value))
