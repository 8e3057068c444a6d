"""Text functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic characters with one plain counterpart each, in pairs.
CURLY, PLAIN = "“”‘’–—\u00a0", "\"\"''-- "

# Lines that start so are navigation or footer.
BOILERPLATE = (
    "back to top", "explore prizes and laureates", "share this", "facebook", "linkedin", "email this page", "x",
    "navigate to:", "summary", "laureates", "facts", "biographical", "bibliography", "banquet speech", "nominations",
    "photo gallery", "other resources", "award ceremony video", "presentation speech", "prize announcement",
    "press release", "bio-bibliography", "award ceremony speech", "prize presentation", "interview", "prose",
    "article", "documentary", "speed read", "banquet video", "your browser does not support the video tag.", "copyright",
)
GREETINGS = ("your majesties", "your royal highnesses", "ladies and gentlemen")

@cache
def folds() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition leaves of each character beyond ASCII: those that give one letter or
    digit, what they give, and those that give several."""
    one, several = {}, {}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x20000)):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        plain = "".join(x for x in plain.lower() if x.isalnum())
        if plain:
            (one if len(plain) == 1 else several)[chr(code)] = plain
    return "".join(one), "".join(one.values()), several


def trim_all(c: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_text(c: Column, note_end: str = "Source:") -> Column:
    """Drop translator notes that begin with *Translated and reach a line with note_end, short bracketed
    notes, typographic characters, and surplus spaces and line breaks. Null stays null."""
    c = F.regexp_replace(trim_all(c), rf"(?is)\*Translated.*?{note_end}.*", "")
    c = F.regexp_replace(c, r"\[[^\]]{0,80}\]", "")
    c = F.replace(F.translate(c, CURLY, PLAIN), F.lit("…"), F.lit("..."))
    for pattern, to in ((r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r" +\n", "\n"), (r"\n +", "\n")):
        c = F.regexp_replace(c, pattern, to)
    return trim_all(c)


def normalize_whitespace(c: Column) -> Column:
    """One space between words, at most one blank line, none before punctuation."""
    for pattern, to in ((r"[ \t]+", " "), (r"\n{2,}", "\n\n"), (r" *\n *", "\n"), (r" ([,.:;])", "$1")):
        c = F.regexp_replace(c, pattern, to)
    return trim_all(c)


def _starts(prefixes: Sequence[str]) -> str:
    return "^(" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")"


def drop_boilerplate(c: Column, prefixes: Sequence[str] = BOILERPLATE, award: str | None = None) -> Column:
    """Trimmed lines without blank ones and without those that begin with one of the prefixes, or with the
    award's name and lecture or diploma."""
    prefixes = (*prefixes, *(f"{award.lower()} {x}" for x in ("lecture", "diploma"))) if award else prefixes
    lines = F.transform(F.split(c, "\n"), trim_all)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~F.lower(x).rlike(_starts(prefixes))), "\n")


def cut_ceremony(c: Column, marker: str = "to cite this section", dropped: Sequence[str] = ("presentation speech by", "translation from", *GREETINGS)) -> Column:
    """Lines before the first that contains the marker, without those that begin with a dropped prefix."""
    lines = F.split(c, "\n")
    hit = F.array_position(F.transform(lines, lambda x: F.contains(F.lower(x), F.lit(marker))), True).cast("int")
    before = F.when(hit > 0, F.slice(lines, 1, F.greatest(hit - 1, F.lit(0)))).otherwise(lines)
    return F.array_join(F.filter(before, lambda x: ~F.lower(trim_all(x)).rlike(_starts(dropped))), "\n")


def clean_lecture(c: Column, header: str, dropped: Sequence[str] = ("translation from", *GREETINGS)) -> Column:
    """Lines without the header, if that is the first line, and without dropped prefixes."""
    keep = lambda x, i: ~((i == 0) & (F.lower(trim_all(x)) == header.lower())) & ~F.lower(trim_all(x)).rlike(_starts(dropped))
    return F.array_join(F.filter(F.split(c, "\n"), keep), "\n")


def noise_reason(c: Column, header: str, not_found: str) -> Column:
    """Why a text is noise: empty, not_found (header and the phrase), header_only; null if it isn't."""
    body = trim_all(F.coalesce(c, F.lit("")))
    return (
        F.when(body == "", "empty").when(F.contains(body, F.lit(header)) & F.contains(body, F.lit(not_found)), "not_found").when(body == header, "header_only")
    )


def parse_date(c: Column) -> Column:
    """Date from `yyyy-MM-dd` or `d MMMM yyyy` anywhere in the text; anything else is null."""
    iso = F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2})", 1)
    spelled = F.regexp_extract(c, r"(\d{1,2} [A-Za-z]+ \d{4})", 1)
    return F.coalesce(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")), F.try_to_timestamp(spelled, F.lit("d MMMM yyyy"))).cast("date")


def clean_motivation(c: Column) -> Column:
    """Without quotation marks, and with a space between a comma and a capital."""
    return trim_all(F.regexp_replace(F.regexp_replace(c, "[\"“”]", ""), r",([A-Z])", ", $1"))


def gender_from_pronouns(c: Column, male: Sequence[str] = ("he", "his"), female: Sequence[str] = ("she", "her")) -> Column:
    """Male or Female by the first list that has a whole word in the text; null if none."""
    words = F.split(F.lower(c), r"[^\p{L}\p{N}_]+")
    has = lambda names: F.arrays_overlap(words, F.array(*map(F.lit, names)))
    return F.when(has(male), "Male").when(has(female), "Female")


def country_from_place(c: Column) -> Column:
    """What follows the last comma."""
    return F.trim(F.element_at(F.split(c, ","), -1))


def last_name(c: Column) -> Column:
    """Last word in lower case; null without a word."""
    return F.nullif(F.lower(F.element_at(F.split(F.trim(c), r"\s+"), -1)), F.lit(""))


def folded_key(c: Column) -> Column:
    """Lower case, accents folded as compatibility decomposition does, ASCII letters and digits only."""
    accented, folded, several = folds()
    wide = F.from_json(F.lit(json.dumps(several)), "map<string, string>")
    spelled = lambda x: F.array_join(F.transform(F.split(x, ""), lambda ch: F.coalesce(F.try_element_at(wide, ch), ch)), "")
    c = F.when(F.length(F.translate(c, "".join(several), "")) < F.length(c), spelled(c)).otherwise(c)
    return F.regexp_replace(F.lower(F.translate(c, accented, folded)), "[^a-z0-9]", "")


def truncated(c: Column, n: int = 500, mark: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def fill_template(template: Column, **values: Column) -> Column:
    """Replace {name} by a column for each value, one after the other; null fills in nothing."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def words(c: Column) -> Column:
    """Words between white space, without empty ones; null gives no words."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def without_stop_words(c: Column, stop: Sequence[str], shortest: int = 3) -> Column:
    """Tokens of at least `shortest` characters that aren't stop words."""
    return F.filter(tokens(c), lambda w: (F.length(w) >= shortest) & ~w.isin(*stop))


def first_line(c: Column) -> Column:
    """First line that isn't blank, trimmed; null if there is none."""
    return F.get(F.filter(F.transform(F.split(c, "\n"), trim_all), lambda x: x != ""), 0)


def distinct_paragraphs(c: Column, pattern: str = "\n") -> Column:
    """Trimmed paragraphs in order, each once, without blank ones."""
    return F.array_join(F.array_distinct(F.filter(F.transform(F.split(c, pattern), trim_all), lambda x: x != "")), "\n")


def file_key(name: Column) -> tuple[Column, Column]:
    """Year and last name of `{year}_{lastname}.txt` or `{year}.txt`."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    parts = F.split(stem, "_", 2)
    return F.get(parts, 0).try_cast("int"), F.lower(F.get(parts, 1))
