"""Text functions on columns.

Words are runs of letters, letter numbers and other numbers (``\\p{L}\\p{Nl}\\p{No}``), as
``[^\\W\\d_]`` has them; a word character is ``[\\p{L}\\p{N}_]``.  Lower-casing is the JVM's
plus ``ß`` to ``ss``, which is full case folding for most letters.  A text with a mark, or
any character for which that is not known, is normalised and folded in
:mod:`corpusloom.functions.unicode`; the others never leave the JVM (``exact=False``: none
does).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import unicode

# Letters and marks that are folded to one form, in the order of their kinds.
CONFUSABLE = "űûɑɡʊʉει" + "‐‑–—" + "‘‛′" + "“”„«»″" + "   "
FOLDED = "ũũagʋʋɛɩ" + "----" + "’’’" + '""""""' + "   "
# The 30 letters of the Mooré alphabet, those that no neighbour language has, and those that borrowings bring.
ALPHABET = "a ã b d e ẽ ɛ f g h i ĩ ɩ k l m n o õ p r s t u ũ ʋ v w y z".split()
UNIQUE = "ãẽĩõũɛɩʋ"
BORROWED = "cjqxéèêëàâôûîïçùœæ"
# French words that are not Mooré words too.
FRENCH = (
    "le les des une est pas qui que dans pour avec sur son sa ses ils elle nous vous leur cette ce au aux du il elles"
    " mais donc par plus tout tous comme quand sont etre avoir fait dit"
).split()
FRENCH_SHARE = 0.15
COVERAGE = 0.6

WORD = r"[\p{L}\p{Nl}\p{No}]+"
NOT_WORD_CHARACTER = r"[^\p{L}\p{N}_]"
SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]+"


def _where_odd(text: Column, exactly, otherwise: Column) -> Column:
    # ASCII alone, told by its length, is never odd
    odd = (F.octet_length(text) != F.length(text)) & text.rlike(unicode.odd())
    return F.coalesce(exactly(F.when(odd, text)), otherwise)


def folded(text: Column, exact: bool = True) -> Column:
    """Case-folded text in normal form C."""
    plain = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return _where_odd(text, unicode.folded, plain) if exact else plain


def casefolded(text: Column, exact: bool = True) -> Column:
    """Case-folded text as it stands, whatever its normal form."""
    plain = folded(text, False)
    return _where_odd(text, unicode.casefold, plain) if exact else plain


def clean(text: Column, exact: bool = True) -> Column:
    """Normal form C, confusables folded, white space collapsed and stripped."""
    text = _where_odd(text, unicode.nfc, text) if exact else text
    return F.trim(F.regexp_replace(F.translate(text, CONFUSABLE, FOLDED), SPACE, " "))


def key(text: Column, exact: bool = True) -> Column:
    """The relaxed comparison key: case, punctuation and white space erased; digits and underscores stay."""
    return F.regexp_replace(folded(text, exact), NOT_WORD_CHARACTER, "")


def words(text: Column, exact: bool = True) -> Column:
    """Array of the case-folded words; found on text that is not normalised."""
    return F.regexp_extract_all(casefolded(text, exact), F.lit(f"({WORD})"))


def tokens(text: Column) -> Column:
    """Array of what white space parts."""
    return F.filter(F.split(text, SPACE), lambda x: x != "")


def has_unique_letter(text: Column, letters: str = UNIQUE, exact: bool = True) -> Column:
    return folded(text, exact).rlike(f"[{letters}]")


def share_in(found: Column, lexicon: list[str]) -> Column:
    """Share of the words that are in ``lexicon``; 0 without words."""
    known = F.array(*map(F.lit, lexicon)) if lexicon else F.array().cast("array<string>")
    return F.when(F.size(found) > 0, F.size(F.filter(found, lambda w: F.array_contains(known, w))) / F.size(found)).otherwise(F.lit(0.0))


def french_share(text: Column) -> Column:
    return share_in(words(text), FRENCH)


def lexicon_coverage(text: Column, lexicon: list[str]) -> Column:
    return share_in(words(text), lexicon)


def written_in_moore(text: Column, lexicon: list[str] | None = None, coverage: float = COVERAGE, letters: str = UNIQUE, exact: bool = True) -> Column:
    """A unique letter; else no French and, with a lexicon, enough of its words, or two words at least."""
    found = words(text, exact)
    rest = F.size(found) >= 2 if lexicon is None else share_in(found, lexicon) >= coverage
    return F.when(has_unique_letter(text, letters, exact), True).when(F.size(found) == 0, False).when(share_in(found, FRENCH) >= FRENCH_SHARE, False).otherwise(rest)


def outside_alphabet(text: Column, alphabet: list[str] = ALPHABET, exact: bool = True) -> Column:
    """Sorted array of the distinct letters that are not in ``alphabet``."""
    letters = F.array_distinct(F.filter(F.split(folded(text, exact), ""), lambda c: c.rlike(r"^\p{L}$")))
    return F.array_sort(F.array_except(letters, F.array(*map(F.lit, alphabet))))


def foreign_letters(text: Column, alphabet: list[str] = ALPHABET, borrowed: str = BORROWED, exact: bool = True) -> Column:
    return F.array_sort(F.array_except(outside_alphabet(text, alphabet, exact), F.array(*map(F.lit, borrowed))))


def overlap(a: Column, b: Column) -> Column:
    """Share of the distinct words of ``a`` that ``b`` has too."""
    first, second = F.array_distinct(tokens(casefolded(a))), F.array_distinct(tokens(casefolded(b)))
    return F.size(F.array_intersect(first, second)) / F.greatest(F.size(first), F.lit(1))


def bag_of_words(text: Column) -> Column:
    return F.array_join(F.array_sort(words(text)), " ")


def opening(text: Column, n: int = 2) -> Column:
    """The first ``n`` words that white space parts, joined by a space."""
    return F.array_join(F.slice(tokens(text), 1, n), " ")


def first_line(reply: Column) -> Column:
    """The first line that is not blank, stripped, then without quotes at its ends; empty if there is none."""
    lines = F.transform(F.split(reply, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: F.regexp_replace(x, f"^{SPACE}|{SPACE}$", ""))
    line = F.coalesce(F.get(F.filter(lines, lambda x: x != ""), 0), F.lit(""))
    return F.regexp_replace(line, '^["«» ]+|["«» ]+$', "")


def in_target_language(hypothesis: Column, direction: Column) -> Column:
    return written_in_moore(hypothesis) == (direction == "french_to_moore")


def source_side(text: Column) -> Column:
    """What stands before the first blank line of a bilingual text; all of it if there is none."""
    return F.split_part(text, F.lit("\n\n"), F.lit(1))


# The instruction of each direction, the text after it.
PROMPTS = {"french_to_moore": "Traduis cette phrase en mooré.\n\n{}", "moore_to_french": "Traduis cette phrase en français.\n\n{}"}


def translation_prompt(text: Column, direction: Column, prompts: dict[str, str] = PROMPTS) -> Column:
    out = F.lit(None).cast("string")
    for name, template in prompts.items():
        head, _, tail = template.partition("{}")
        out = F.when(direction == name, F.concat(F.lit(head), text, F.lit(tail))).otherwise(out)
    return out


def decimal_comma(number: Column) -> Column:
    return F.translate(number.cast("string"), ".", ",")


def file_name(name: Column) -> Column:
    """A name that can be a file's."""
    return F.translate(name, "+/", "__")
