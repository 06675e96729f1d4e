"""Folding, tokens, and the predicates on them, as column expressions."""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stopword list.
ENGLISH_STOPWORDS = (
    "I ME MY MYSELF WE OUR OURS OURSELVES YOU YOUR YOURS "
    "YOURSELF YOURSELVES HE HIM HIS HIMSELF SHE HER HERS HERSELF IT "
    "ITS ITSELF THEY THEM THEIR THEIRS THEMSELVES WHAT WHICH WHO WHOM "
    "THIS THAT THESE THOSE AM IS ARE WAS WERE BE BEEN "
    "BEING HAVE HAS HAD HAVING DO DOES DID DOING A AN "
    "THE AND BUT IF OR BECAUSE AS UNTIL WHILE OF AT "
    "BY FOR WITH ABOUT AGAINST BETWEEN INTO THROUGH DURING BEFORE AFTER "
    "ABOVE BELOW TO FROM UP DOWN IN OUT ON OFF OVER "
    "UNDER AGAIN FURTHER THEN ONCE HERE THERE WHEN WHERE WHY HOW "
    "ALL ANY BOTH EACH FEW MORE MOST OTHER SOME SUCH NO "
    "NOR NOT ONLY OWN SAME SO THAN TOO VERY S T "
    "CAN WILL JUST DON SHOULD NOW"
).split()


def fold(text: Column, how: str = "ascii") -> Column:
    """Upper case: 'ascii' touches a-z alone, 'unicode' is full upper-casing."""
    if how == "ascii":
        return F.translate(text, string.ascii_lowercase, string.ascii_uppercase)
    if how == "unicode":
        return F.upper(text)
    raise ValueError(f"fold is 'ascii' or 'unicode', not {how!r}")


def fold_str(text: str, how: str = "ascii") -> str:
    """The same fold of a Python string."""
    if how == "unicode":
        return text.upper()
    return text.translate(str.maketrans(string.ascii_lowercase, string.ascii_uppercase))


def flat_text(text: Column, first_line_only: bool = False) -> Column:
    """One line of text: null is empty, line breaks are spaces or end the text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.split_part(text, F.lit("\n"), F.lit(1)) if first_line_only else F.replace(text, F.lit("\n"), F.lit(" "))


def tokens(text: Column, how: str = "ascii", first_line_only: bool = False) -> Column:
    """The non-empty tokens between single spaces, folded; tabs and punctuation stay inside."""
    return F.array_remove(F.split(fold(flat_text(text, first_line_only), how), " "), "")


def token_count(text: Column, first_line_only: bool = False) -> Column:
    return F.size(F.array_remove(F.split(flat_text(text, first_line_only), " "), "")).cast("int")


def is_valid_token(token: Column) -> Column:
    """All but a lone ASCII character that is no letter or digit."""
    return (F.length(token) > 1) | (F.ascii(token) > 127) | token.rlike("^[0-9A-Za-z]$")


def is_valid_str(token: str) -> bool:
    return len(token.encode()) > 1 or token.isalnum()


def stopword_set(stopwords: str | Iterable[str], how: str = "ascii") -> list[str]:
    """'english', or any words, folded like the text."""
    if isinstance(stopwords, str):
        if stopwords != "english":
            raise ValueError("stopwords is 'english' or a collection of words")
        return list(ENGLISH_STOPWORDS)
    return sorted({fold_str(w, how) for w in stopwords})


def query_tokens(text: str, how: str = "ascii", stopwords: Iterable[str] = ()) -> list[str]:
    """The terms of a query text, in order, repeats included."""
    banned = set(stopwords)
    flat = fold_str(text.replace("\n", " "), how)
    return [t for t in flat.split(" ") if t and is_valid_str(t) and t not in banned]
