"""Text expressions: tokens, stems, budgets, ids. All are built-in functions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ranges of characters that are tokens each, what else makes a token, what is stripped from its ends.
CJK = r"぀-ヿ㐀-䶿一-鿿가-힯豈-﫿"
_INNER = rf"[\p{{L}}\p{{N}}_&&[^{CJK}]]"
#: A token ends in a letter, digit or underscore: marks behind it are not part of it.
TOKEN = rf"[\p{{L}}\p{{N}}&&[{CJK}]]|{_INNER}(?:[{_INNER}:+./-]*{_INNER})?"
MARKS = r"^[./:+-]+|[./:+-]+$"
#: TOKEN in texts of ASCII, and the accents that Latin letters lose.
PLAIN_TOKEN = r"[a-z0-9_](?:[a-z0-9_:+./-]*[a-z0-9_])?"
LATIN_MARKS = "(?<=[a-z])[\u0300-\u036f]+"

# Words that a query is stripped of where others are left.
STOPWORDS = (
    "a about actually all also an and are as at be been being but by can could did do does for from had has have how i in into is it its "
    "just me more most my not now of on or our please really should some still than that the their them then there these they this those "
    "to was we were what when where which who why will with would you your"
).split()

# Stems of irregular words.
IRREGULAR = {
    "bought": "buy", "built": "build", "drove": "driv", "driven": "driv", "found": "find", "gave": "giv", "given": "giv", "goes": "go",
    "going": "go", "went": "go", "made": "mak", "paid": "pay", "ran": "run", "said": "say", "saw": "see", "seen": "see", "sent": "send",
    "sold": "sell", "spent": "spend", "took": "tak", "taken": "tak", "told": "tell", "written": "writ", "wrote": "writ",
}


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


@lru_cache(maxsize=1)
def folds() -> tuple[dict[str, str], dict[str, str]]:
    """Characters and what they are folded to, case and accents of Latin letters: those that become one character, and those
    that become several. Made by rule."""
    one, many = {}, {}
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]):
        low = unicodedata.normalize("NFD", c.casefold())
        low = unicodedata.normalize("NFC", re.sub(LATIN_MARKS, "", low))
        if low != c:
            (one if len(low) == 1 else many)[c] = low
    return one, many


def _ranges(chars: list[str], gap: int = 64) -> str:
    """A class of a few ranges that holds the characters, and what lies between near ones."""
    out: list[list[str]] = []
    for c in sorted(chars):
        if out and ord(c) - ord(out[-1][1]) <= gap:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{ord(lo):x}}}-\\x{{{ord(hi):x}}}" for lo, hi in out) + "]"


def fold(text: Column) -> Column:
    """Lower case without accents on Latin letters, ligatures and other characters spelt out."""
    one, many = folds()
    spelt = F.create_map(*(F.lit(x) for p in many.items() for x in p))
    spelt = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(spelt, c), c)), "")

    def bare(t: Column) -> Column:
        return F.regexp_replace(F.translate(F.replace(F.lower(t), F.lit("ß"), F.lit("ss")), "".join(one), "".join(one.values())), LATIN_MARKS, "")

    # Texts with a character spelt out are taken apart; the sharp s is too common for that.
    beyond, rare = F.octet_length(text) > F.length(text), [c for c in many if c != "ß"]
    return F.when(beyond & text.rlike(_ranges(rare)), bare(spelt)).when(beyond, bare(text)).otherwise(F.lower(text))


def stripped(token: Column) -> Column:
    return F.regexp_replace(token, MARKS, "")


def tokenize(text: Column) -> Column:
    """Tokens in folded case without marks at their ends; a token with hyphens is followed by its parts. A character of
    Chinese, Japanese or Korean is a token. A null text has none."""

    def parts(t: Column) -> Column:
        own = F.filter(F.transform(F.split(t, "-"), stripped), lambda p: (p != "") & (p != t))
        return F.when(t.contains("-"), F.concat(F.array(t), own)).otherwise(F.array(t))

    def found(f: Column) -> Column:
        return F.when(F.octet_length(f) == F.length(f), F.regexp_extract_all(f, F.lit(PLAIN_TOKEN), 0)).otherwise(F.regexp_extract_all(f, F.lit(TOKEN), 0))

    own = let(fold(F.coalesce(text, F.lit(""))), found)
    return F.when(text.contains("-"), F.flatten(F.transform(own, parts))).otherwise(own)


def counted(tokens: Column) -> Column:
    """(term, first) of all tokens in the order of terms; first marks one of each term. Summed by term these give the
    term's occurrences and documents with no shuffle by document."""
    return let(F.array_sort(tokens), lambda t: F.transform(t, lambda x, i: F.struct(x.alias("term"), ((i == 0) | (F.get(t, i - 1) != x)).alias("first"))))


def _cut(word: Column, n: int) -> Column:
    return F.left(word, F.length(word) - n)


def stem(token: Column) -> Column:
    """Plural, -ing and -ed endings and a last e go; y stands for ies and ied; irregular words by a table. Words of fewer
    than four letters, and those that are not all a-z, stay."""

    def single(base: Column) -> Column:
        """Without the second of two equal consonants at the end, but for l, s and z."""
        double = (F.length(base) >= 3) & (F.right(base, F.lit(1)) == F.substring(base, -2, 1)) & ~base.rlike("[lsz]$")
        return F.when(double, _cut(base, 1)).otherwise(base)

    def plural(t: Column) -> Column:
        n = F.length(t)
        return (
            F.when((n >= 5) & t.rlike("es$") & ~t.rlike("[aeo]es$"), F.when(t.rlike("(ch|sh|ss|x|z)es$"), _cut(t, 2)).otherwise(_cut(t, 1)))
            .when(t.rlike("s$") & ~t.rlike("[suiao]s$"), _cut(t, 1))
            .otherwise(t)
        )

    def ending(t: Column) -> Column:
        n = F.length(t)
        return F.when((n >= 6) & t.endswith("ing"), single(_cut(t, 3))).when((n >= 5) & t.endswith("ed") & ~t.endswith("eed"), single(_cut(t, 2))).otherwise(t)

    def silent(t: Column) -> Column:
        return F.when((F.length(t) >= 4) & t.endswith("e") & ~t.rlike("[eiyo]e$"), _cut(t, 1)).otherwise(t)

    irregular = F.create_map(*(F.lit(x) for pair in IRREGULAR.items() for x in pair))
    low = F.lower(token)
    regular = F.when((F.length(low) < 4) | ~low.rlike("^[a-z]+$"), low).when((F.length(low) >= 5) & low.rlike("ie[sd]$"), F.concat(_cut(low, 3), F.lit("y")))
    return F.coalesce(F.try_element_at(irregular, low), regular.otherwise(let(let(plural(low), ending), silent)))


def query_terms(tokens: Column) -> Column:
    """Stems of the tokens that are no stopwords, or of all where all are."""
    content = F.filter(tokens, lambda t: ~t.isin(STOPWORDS))
    return F.transform(F.when(F.size(content) > 0, content).otherwise(tokens), stem)


def normalized(text: Column) -> Column:
    """Words of a-z and 0-9 in lower case, one space between."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), " ")


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def content_id(text: Column) -> Column:
    return F.sha2(text, 256)


def osa_at_most_one(a: Column, b: Column) -> Column:
    """Whether one edit, or one swap of neighbours, at most parts the words."""
    same = lambda i: F.substring(a, 1, i) == F.substring(b, 1, i)
    n = F.length(a)
    swapped = F.exists(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: same(i - 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i + 1, F.lit(1))) & (F.substr(a, i + 1, F.lit(1)) == F.substr(b, i, F.lit(1))) & (F.substr(a, i + 2) == F.substr(b, i + 2)),
    )
    return (F.levenshtein(a, b) <= 1) | ((n == F.length(b)) & (n >= 2) & swapped)


# Kin that are called by more than one word.
KIN = ("mom mother mama", "dad father papa", "grandma grandmother", "grandpa grandfather", "kid child", "kids children")


def normalised(term: Column) -> Column:
    """A query's term without its commonest endings, and some words by their root."""

    def by_suffix(t: Column) -> Column:
        out = None
        for suffix in ("ingly", "edly", "ing", "ied", "ies", "ed", "es", "s"):
            hit = (F.length(t) > len(suffix) + 3) & t.endswith(suffix)
            value = F.concat(_cut(t, 3), F.lit("y")) if suffix in ("ied", "ies") else _cut(t, len(suffix))
            out = F.when(hit, value) if out is None else out.when(hit, value)
        short = (F.length(t) == 4) & t.endswith("s") & ~t.rlike("([suiao]s|yes|was|has|his)$")
        return out.when(short, _cut(t, 1)).otherwise(t)

    low = F.lower(term)
    odd = F.when(low.isin("owned", "owning", "owns"), "own").when(low.isin("notifications", "notification", "notified", "notifies", "notify"), "notify").when(low == "co2", "carbon")
    return odd.otherwise(by_suffix(low))


def similar(a: Column, b: Column) -> Column:
    """Whether two terms may stand for each other: equal, kin, one the other and an ending, or one edit apart."""
    kin = None
    for group in KIN:
        both = a.isin(group.split()) & b.isin(group.split())
        kin = both if kin is None else kin | both
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    rest = F.substr(long, F.length(short) + 1)
    ending = (F.length(short) >= 4) & long.startswith(short) & (rest.isin("s", "e", "d", "y", "ed", "es", "ing") | rest.rlike("^[-_]."))
    letters = r"^\p{L}{6,}$"
    near = a.rlike(letters) & b.rlike(letters) & (F.left(a, F.lit(1)) == F.left(b, F.lit(1))) & osa_at_most_one(a, b)
    return (a == b) | kin | ending | near
