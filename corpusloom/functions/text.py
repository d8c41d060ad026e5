"""Text functions as columns. Each stays in the JVM; names ending in ``_py`` are the same for one Python string."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed


@cache
def fold_tables() -> tuple[str, str, dict[str, str]]:
    """By rule over the planes that have letters which unfold (Hangul syllables, which come apart by arithmetic, aside): letters that unfold to one, with marks that
    folding drops last, for they have no counterpart; and letters that unfold to several or to none."""
    single, several, marks = {}, {}, []
    for at in range(0xA0, 0x30000):
        if 0xAC00 <= at <= 0xD7A3 or 0xD800 <= at < 0xE000:
            continue
        c = chr(at)
        if c != c.lower():
            continue
        plain = fold_py(c)
        if not plain:
            marks.append(c)
        elif plain != c:
            (single if len(plain) == 1 else several)[c] = plain
    return "".join([*single, *marks]), "".join(single.values()), several


def fold_py(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


_JAMO = ["".join(map(chr, range(first, first + n))) for first, n in ((0x1100, 19), (0x1161, 21), (0x11A7, 28))]


def _syllable(c: Column) -> Column:
    """The letters of a Hangul syllable."""
    n = F.ascii(c) - 0xAC00
    lead, vowel, tail = F.floor(n / 588), F.floor((n % 588) / 28), n % 28
    letter = lambda k, at: F.substring(F.lit(_JAMO[k]), (at + 1).cast("int"), F.lit(1))
    return F.concat(letter(0, lead), letter(1, vowel), F.when(tail > 0, letter(2, tail)).otherwise(""))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), 0)


def fold(text: Column) -> Column:
    """Lower case without accents, compatibility letters (ligatures, fractions, full-width letters) unfolded: ``fold_py`` as a column.
    Text that is all ASCII takes the short way. What unfolds to several letters is rare: whether there is any is told by a comparison
    of lengths without such letters, and only then are they looked up."""
    one, to, several = fold_tables()
    all_of, made = "".join(several), "\x01".join(several.values())

    def unfolded(plain: Column) -> Column:
        rare = F.array_distinct(F.filter(F.split(plain, ""), lambda c: (c != "") & (F.translate(c, all_of, "") == "")))
        of = lambda c: F.get(F.split(F.lit(made), "\x01", -1), F.instr(F.lit(all_of), c) - 1)
        some = F.char_length(F.translate(plain, all_of, "")) < F.char_length(plain)
        return F.when(some, F.aggregate(rare, plain, lambda t, c: F.replace(t, c, of(c)))).otherwise(plain)

    def parted(whole: Column) -> Column:
        letters = F.transform(F.split(whole, ""), lambda c: F.when(c.between("가", "힣"), _syllable(c)).otherwise(c))
        return F.when(whole.rlike("[가-힣]"), F.array_join(letters, "")).otherwise(whole)

    beyond = once(once(F.translate(F.lower(text), one, to), unfolded), parted)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(beyond)


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with one more column that is computed once: no filter or projection above can take its expression in again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def letters(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"\P{L}", ""))


def uppercase_ratio(text: Column) -> Column:
    n = letters(text)
    return F.when(n > 0, F.char_length(F.regexp_replace(text, r"\P{Lu}", "")) / n).otherwise(F.lit(0.0))


def uppercase_ratio_py(text: str) -> float:
    n = sum(map(str.isalpha, text))
    return sum(map(str.isupper, filter(str.isalpha, text))) / n if n else 0.0


def java(pattern: str) -> str:
    """A Python pattern with Python's meaning in the JVM: case folding and classes of Unicode, lines that end at LF only."""
    return "(?ud)" + pattern if "(?i" in pattern else "(?d)" + pattern


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(java(pattern))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(java(pattern)))


def count_substring(text: Column, term: Column) -> Column:
    """Occurrences that do not overlap."""
    return ((F.char_length(text) - F.char_length(F.replace(text, term, F.lit("")))) / F.char_length(term)).cast("int")


def dehyphenate(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def is_noise_line(line: Column) -> Column:
    """Page numbers, roman numbers, dot leaders, digit runs, lone links, ISBNs and short advertising lines."""
    s = F.trim(line)
    shape = "|".join(f"({p})" for p in (fixed.PAGE_NUMBER, fixed.ROMAN_NUMBER, fixed.DOT_LEADER, fixed.DIGIT_RUN))
    return (s != "") & (s.rlike(shape) | matches(s, fixed.URL_ONLY) | matches(s, fixed.ISBN_LINE) | (matches(s, fixed.SPAM_LINE) & (F.char_length(s) < 200)))


def strip_table_row(line: Column) -> Column:
    """The cells of a table row as running text, or null if none is worth keeping."""
    cells = F.transform(F.split(F.btrim(F.trim(line), F.lit("|")), r"\|", -1), lambda c: F.trim(c))
    good = F.filter(cells, lambda c: c.rlike("[A-Za-zÀ-ÿ0-9]") & ~F.concat(F.lit("|"), c, F.lit("|")).rlike(fixed.SEPARATOR_ROW))
    joined = F.array_join(good, " ")
    return F.when(F.char_length(joined) >= 3, joined)


def words(text: Column, pattern: str = "[A-Za-zÀ-ÿ]+") -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def garbage_run_ratio(text: Column, first: int | None = None) -> Column:
    """The share of words that stand in runs of one-letter words (what a broken extraction leaves); short texts have none.
    ``first``: only so many letters of a text are looked at; else all.

    Words become x (one letter) or w, so that runs are a pattern over a short string."""
    marks = F.array_join(F.transform(words(F.substring(text, 1, first) if first else text), lambda w: F.when(F.char_length(w) == 1, F.lit("x")).otherwise(F.lit("w"))), "")

    def ratio(m: Column) -> Column:
        in_runs = F.char_length(m) - F.char_length(F.regexp_replace(m, f"x{{{fixed.GARBAGE_MIN_RUN},}}", ""))
        return F.when(F.char_length(m) < fixed.GARBAGE_MIN_WORDS, F.lit(0.0)).otherwise(in_runs / F.char_length(m))

    return once(marks, ratio)


def with_language(df: DataFrame, text: str, out: str, first: int | None = None) -> DataFrame:
    """The language with most stop words; the first listed of equals; Portuguese below three. Words are parted once and
    looked up, which costs a fraction of a search for each list. ``first``: only so many letters of a text are looked at; else all."""
    split = held(df, "_words", F.split(fold(F.substring(text, 1, first) if first else F.col(text)), r"(?U)\W+"))

    def count(stop: list[str]) -> Column:
        return F.size(F.filter("_words", lambda w: w.isin(*stop)))

    counts = {lang: count(stop.split("|")) for lang, stop in fixed.LANGUAGE_WORDS.items()}
    counted = held(split, "_scores", F.struct(*(c.alias(lang) for lang, c in counts.items())))
    best = F.greatest(*(F.col(f"_scores.{lang}") for lang in counts))
    chosen = F.when(F.coalesce(best, F.lit(0)) < 3, F.lit("pt"))
    for lang in counts:
        chosen = chosen.when(F.col(f"_scores.{lang}") == best, F.lit(lang))
    return counted.withColumn(out, chosen).drop("_words", "_scores")


def any_contains(text: Column, terms: Sequence[str]) -> Column:
    found = F.lit(False)
    for term in dict.fromkeys(map(fold_py, terms)):
        found = found | F.contains(text, F.lit(term))
    return found


def heuristic_region(folded: Column, lang: Column) -> Column:
    chosen = None
    for region, terms in fixed.REGION_KEYWORDS.items():
        test = any_contains(folded, terms)
        chosen = F.when(test, F.lit(region)) if chosen is None else chosen.when(test, F.lit(region))
    return chosen.when(lang == "pt", F.lit("brasileira")).otherwise(F.lit("internacional"))


def heuristic_dish_types(folded: Column, tier: Column) -> Column:
    hits = F.array(*(F.when(any_contains(folded, terms), F.lit(dish)) for dish, terms in fixed.DISH_KEYWORDS.items()))
    found = F.filter(hits, lambda d: d.isNotNull())
    technique = F.lit("tecnica_e_fundamento")
    found = F.when((tier == "tecnica") & ~F.array_contains(found, technique), F.array_append(found, technique)).otherwise(found)
    return F.when(F.size(found) == 0, F.array(F.lit("prato_principal"))).otherwise(found)


def stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "^.*/", ""), r"(?<=.)\.[^.]*$", "")


def safe_slug(name: Column) -> Column:
    slug = F.substring(F.regexp_replace(F.trim(F.replace(stem(name), F.lit("Copy of "), F.lit(""))), r"(?U)[^\w\-. À-ÿ]", "_"), 1, 150)
    return F.when(slug == "", F.lit("livro")).otherwise(slug)


def book_title(name: Column) -> Column:
    return F.trim(F.replace(F.replace(stem(name), F.lit("Copy of "), F.lit("")), F.lit("_"), F.lit(" ")))


def safe_filename(name: Column) -> Column:
    """The base name with control characters replaced, 200 letters at most, its suffix kept."""
    base = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"[\x00-\x1f\x7f]", "_")
    suffix = F.regexp_extract(base, r"(\.[^.]*)$", 1)
    return F.when(F.char_length(base) <= 200, base).otherwise(F.concat(F.substring(base, F.lit(1), F.lit(200) - F.char_length(suffix)), suffix))


def extension(name: Column) -> Column:
    """The supported format that a file name's suffix says, or null."""
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    for alias, target in fixed.FORMAT_ALIASES.items():
        ext = F.when(ext == alias, F.lit(target)).otherwise(ext)
    return F.when(ext.isin(*fixed.FORMATS), ext)


def url_host(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", ""), url)


def strip_citations(answer: Column) -> Column:
    return F.trim(F.regexp_replace(answer, fixed.CITATION, ""))


def truncate_answer(answer: Column, limit: int = fixed.MAX_ANSWER_CHARS) -> Column:
    """Citations removed; if longer than ``limit``, cut there, then before the last space, and marked."""
    plain = strip_citations(answer)
    cut = F.substring(plain, 1, limit)
    at_space = F.when(F.contains(cut, F.lit(" ")), F.regexp_extract(cut, r"(?s)^(.*) ", 1)).otherwise(cut)
    return F.when(F.char_length(plain) > limit, F.concat(at_space, F.lit(" …"))).otherwise(plain)


def truncate_answer_py(answer: str, limit: int = fixed.MAX_ANSWER_CHARS) -> str:
    plain = re.sub(fixed.CITATION, "", answer).strip()
    return plain if len(plain) <= limit else re.sub(r"(?s)^(.*) .*$", r"\1", plain[:limit]) + " …"


def embed_text(title: Column, text: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat_ws("\n", title, text)).otherwise(text)


def iso_micros(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def page_has_text(text: Column) -> Column:
    return letters(text) >= fixed.PAGE_MIN_LETTERS


def text_coverage(empty_pages: Column, pages: Column) -> Column:
    share = empty_pages / pages
    return F.when(F.coalesce(pages, F.lit(0)) == 0, F.lit("ok")).when(share >= fixed.NO_TEXT_SHARE, F.lit("no_text")).when(share >= fixed.PARTIAL_TEXT_SHARE, F.lit("partial_text")).otherwise(F.lit("ok"))


def upper_median(values: Column) -> Column:
    ordered = F.sort_array(values)
    return F.get(ordered, F.shiftright(F.size(ordered), 1))


def distinct_ignoring_case(values: Column) -> Column:
    """First spellings in order."""
    return F.aggregate(values, F.array().cast("array<string>"), lambda kept, v: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(v)), kept).otherwise(F.array_append(kept, v)))


def progress_percent(current: Column, total: Column) -> Column:
    return F.when(F.coalesce(total, F.lit(0)) > 0, F.round(100 * F.coalesce(current, F.lit(0)) / total))


def tool_arguments(text: Column) -> Column:
    """A JSON object as a map of its members' JSON; anything else is an empty map."""
    parsed = F.from_json(text, "map<string,string>")
    return F.when(F.ltrim(text).startswith("{"), F.coalesce(parsed, F.create_map().cast("map<string,string>"))).otherwise(F.create_map().cast("map<string,string>"))
