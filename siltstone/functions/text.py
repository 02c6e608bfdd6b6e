"""Text functions: Column in, Column out, all inside whole-stage code generation or array functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import lexicon

#: What Python's re calls a word character, and the blanks that str.strip drops in ASCII.
WORD = r"([\p{L}\p{N}_]+)"
BLANKS = " \t\n\r\x0b\x0c"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@cache
def _folds() -> tuple[str, str, dict[str, str], str]:
    """What full case folding does beyond lower case, but for sharp s: letters for letters, letters for several, and a character class that holds them all."""
    pairs = {chr(c).lower(): chr(c).casefold() for c in range(0x110000) if chr(c).lower() != chr(c).casefold()}
    # Java writes the last sigma of a word in its own form.
    single = {a: b for a, b in pairs.items() if len(a) == len(b) == 1} | {"\u03c2": "\u03c3"}
    many = {a: b for a, b in pairs.items() if len(b) > 1 and a != "\u00df"}
    # A class of a few ranges with some other letters in them is much faster than one of many letters.
    places = sorted(map(ord, "".join([*single, *many])))
    ends = [i for i in range(1, len(places)) if places[i] - places[i - 1] > 8]
    ranges = [(places[i], places[j - 1]) for i, j in zip([0, *ends], [*ends, len(places)], strict=True)]
    return "".join(single), "".join(single.values()), many, "".join(f"\\x{{{x:x}}}-\\x{{{y:x}}}" for x, y in ranges)


def casefold(text: Column) -> Column:
    """Full case folding, as Python's str.casefold: sharp s becomes ss, for example."""
    one, other, many, held = _folds()
    spelled = lambda x: reduce(lambda c, k: F.replace(c, F.lit(k), F.lit(many[k])), many, F.translate(x, one, other))
    # Most texts hold no such letter but sharp s: looking for one costs less than replacing them all.
    return bound(F.replace(F.lower(text), F.lit("\u00df"), F.lit("ss")), lambda x: F.when(x.rlike(f"[{held}]"), spelled(x)).otherwise(x))


def tokens(text: Column) -> Column:
    """Case-folded word tokens, in order; null has none."""
    return F.regexp_extract_all(casefold(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1))


def normalize(text: Column) -> Column:
    """Case-folded word tokens joined by single spaces."""
    return F.array_join(tokens(text), " ")


def ascii_token_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))


def squash(text: Column) -> Column:
    """Everything but ASCII letters and digits becomes one space; none at either end."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def padded(text: Column) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" "))


def contains_phrase(normal_text: Column, normal_phrase: Column) -> Column:
    """Whole-phrase containment in a normalised text; an empty phrase is in none."""
    return (normal_phrase != "") & padded(normal_text).contains(padded(normal_phrase))


def ngrams(words: Column, n: int) -> Column:
    """The set of runs of n words; texts of fewer words have none."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    return bound(words, lambda w: F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(runs(w))))


def safe_id(text: Column, longest: int | None = 100, prefix: Column | None = None) -> Column:
    """Runs of other characters than letters, digits, - and _ become _, none at either end; after `prefix` and _, if given.

    Null where nothing is left: an empty key has no id.
    """
    clean = F.nullif(F.btrim(F.regexp_replace(text, "[^A-Za-z0-9_-]+", "_"), F.lit("_")), F.lit(""))
    named = F.concat(prefix, F.lit("_"), clean) if prefix is not None else clean
    return F.substring(named, 1, longest) if longest else named


def collapse(text: Column) -> Column:
    """Runs of blanks become one space; no blanks and no full stops at the end."""
    return F.rtrim(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("."))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def host_root(url: Column) -> Column:
    """Scheme, host and port of a URL, or null."""
    root = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    return F.when(root != "", root)


def strip_bold(html: Column) -> Column:
    """Without the tags that search results mark hits with."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), "</?b>", "")


def plain_text(html: Column) -> Column:
    """Without tags, with the five named entities of XML and the blank one read, in single spaces."""
    out = F.regexp_replace(html, "<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def pluralize(phrase: Column, irregular: dict[str, str]) -> Column:
    """The phrase, in single spaces, with its last word in the plural: the irregular form, or with an s."""

    def ended(words: Column) -> Column:
        last = F.element_at(words, -1)
        plural = F.concat(last, F.lit("s"))
        for one, many in irregular.items():
            plural = F.when(last == one, F.lit(many)).otherwise(plural)
        return F.array_join(F.concat(F.slice(words, 1, F.size(words) - 1), F.array(plural)), " ")

    return bound(F.split(F.trim(F.regexp_replace(phrase, r"\s+", " ")), " "), ended)


def _reworded(request: Column, verb: str, instead: str) -> Column:
    """The request with its first word, after a please, replaced if it is the verb in any case."""
    words = F.split(request, " ")
    at = F.when(F.lower(words[0]) == lexicon.POLITE, 1).otherwise(0)
    first = F.get(words, at)
    # Punctuation after the verb belongs to no word.
    rest = F.substring(first, len(verb) + 1, 1 << 30)
    is_verb = F.lower(F.left(first, F.lit(len(verb)))).eqNullSafe(F.lit(verb.lower())) & ~F.left(rest, F.lit(1)).rlike(r"\w")
    return F.when(is_verb, F.array_join(F.concat(F.array(F.concat(F.lit(instead), rest)), F.slice(words, at + 2, F.size(words))), " ")).otherwise(request)


def paraphrase(key: Column, request: Column, pick: Column) -> Column:
    """The request, flattened, in one of five wordings that `pick` (0 to 4) chooses, its first letter lowered; if nothing is left, as it was."""
    flat = bound(F.trim(F.regexp_replace(F.rtrim(strip(request), F.lit(".")), r"\s+", " ")), lambda x: x)
    said = bound(flat, lambda x: F.get(F.array(x, *(_reworded(x, *v) for v in lexicon.REWORDINGS.items())), pick.cast("int")))
    return bound(said, lambda x: F.when(x == "", request).otherwise(F.concat(F.lower(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))))


def first_filled(*values: Column) -> Column:
    """The first text that is neither null nor empty, else an empty one."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def refined_query(query: Column, context: Column, word: str = "logo") -> Column:
    """The query, stripped, with the word at its end if the context mentions it and the query does not."""
    q = strip(query)
    return F.when(F.lower(context).contains(word) & ~F.lower(q).contains(word), F.concat(q, F.lit(f" {word}"))).otherwise(q)


def looks_like_image(url: Column) -> Column:
    """Does the URL's path end like an image's name, whatever query follows?"""
    return F.lower(F.regexp_replace(url, r"[?#].*$", "")).rlike(r"\.(png|jpe?g|webp|gif|bmp)$")


def template_signature(normal_text: Column, slots: list[str]) -> Column:
    """Known slot phrases become __slot__, phrases of most words first, then the longest, then in order."""
    out = padded(normal_text)
    for s in sorted(set(slots), key=lambda s: (-len(s.split()), -len(s), s)):
        out = F.replace(out, F.lit(f" {s} "), F.lit(" __slot__ "))
    return F.trim(out)


def signature_pattern(signature: Column) -> Column:
    """Regular expression for texts of a signature: __slot__ stands for any characters, at least one."""
    return F.concat(F.lit("^"), F.replace(F.regexp_replace(signature, r"([^\w\s])", r"\\$1"), F.lit("__slot__"), F.lit(".+?")), F.lit("$"))


def strip_fences(text: Column) -> Column:
    """From the first { to the last }, or null: the object that a model wrapped in prose or code fences."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def numbers_after_colons(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r":\s*([0-9]+\.?[0-9]*)"), F.lit(1)), lambda x: x.cast("double"))


def template(pattern: str, **values: Column) -> Column:
    """pattern with {name} replaced by the column of that name."""
    out = F.lit(pattern)
    for name, column in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), column)
    return out


def is_enabled(value: Column) -> Column:
    """A flag that was written as text: null, "", "false" and "False" are off, anything else is on."""
    return ~F.coalesce(value, F.lit("")).isin("", "false", "False")


def not_blank(text: Column) -> Column:
    """Is there a character that is no blank of any script?"""
    return F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def strip(text: Column) -> Column:
    """Without the blanks of any script at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def count_of(text: Column, part: str) -> Column:
    return F.size(F.split(text, part.replace("<", "[<]"))) - 1


def natural_tokens(name: Column) -> Column:
    """Digit runs as numbers and other characters one by one, as structs that sort numbers by value and before characters."""
    runs = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9])"), F.lit(1))
    number = lambda x: F.when(x.rlike("^[0-9]"), x.cast("decimal(38,0)"))
    return F.transform(runs, lambda x: F.struct(F.coalesce(number(x), F.lit(-1)).alias("number"), F.when(x.rlike("^[0-9]"), "").otherwise(x).alias("char")))


def candidate_number(said: Column, n: Column | int) -> Column:
    """The number after the word Image in a model's answer, 1 if there is none, kept between 1 and n."""
    found = F.regexp_extract(said, r"Image\s+([0-9]+)", 1).try_cast("int")
    return F.greatest(F.lit(1), F.least(n if isinstance(n, Column) else F.lit(n), F.coalesce(found, F.lit(1))))


def is_false_text(text: Column) -> Column:
    """Texts that a planner writes for no: empty, false, none, null, no."""
    return F.coalesce(F.lower(F.trim(text)), F.lit("")).isin("", "false", "none", "null", "no")
