"""English text for comparison: fillers and brackets out, contractions spelled out, spelled numbers as digits.

The rewrites are an ordered fold of `regexp_replace`; only the numbers, whose digits depend on the words around them, are
read in an Arrow function: words become typed tokens, runs of which a `Numeral` takes up one by one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import BRACKETS, bare

# Sounds that are left out; what follows an apostrophe or stands for a longer word, in order.
FILLERS = r"\b(hmm|mm|mhm|mmm|uh|um)\b"
REWRITES = [
    (r"\bwon't\b", "will not"), (r"\bcan't\b", "can not"), (r"\blet's\b", "let us"), (r"\bain't\b", "aint"), (r"\by'all\b", "you all"),
    (r"\bwanna\b", "want to"), (r"\bgotta\b", "got to"), (r"\bgonna\b", "going to"), (r"\bi'ma\b", "i am going to"), (r"\bimma\b", "i am going to"),
    (r"\bwoulda\b", "would have"), (r"\bcoulda\b", "could have"), (r"\bshoulda\b", "should have"), (r"\bma'am\b", "madam"),
    (r"\bmr\b", "mister "), (r"\bmrs\b", "missus "), (r"\bst\b", "saint "), (r"\bdr\b", "doctor "), (r"\bprof\b", "professor "), (r"\bcapt\b", "captain "),
    (r"\bgov\b", "governor "), (r"\bald\b", "alderman "), (r"\bgen\b", "general "), (r"\bsen\b", "senator "), (r"\brep\b", "representative "),
    (r"\bpres\b", "president "), (r"\brev\b", "reverend "), (r"\bhon\b", "honorable "), (r"\basst\b", "assistant "), (r"\bassoc\b", "associate "),
    (r"\blt\b", "lieutenant "), (r"\bcol\b", "colonel "), (r"\bjr\b", "junior "), (r"\bsr\b", "senior "), (r"\besq\b", "esquire "),
    (r"'d been\b", " had been"), (r"'s been\b", " has been"), (r"'d gone\b", " had gone"), (r"'s gone\b", " has gone"), (r"'d done\b", " had done"), (r"'s got\b", " has got"),
    (r"n't\b", " not"), (r"'re\b", " are"), (r"'s\b", " is"), (r"'d\b", " would"), (r"'ll\b", " will"), (r"'t\b", " not"), (r"'ve\b", " have"), (r"'m\b", " am"),
]
# Number words.
UNITS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = "thousand million billion trillion quadrillion quintillion sextillion septillion octillion nonillion decillion".split()
ZEROS = ["o", "oh", "zero"]
ODD_ORDINALS = {"one": ("first", "st"), "two": ("second", "nd"), "three": ("third", "rd"), "five": ("fifth", "th"), "twelve": ("twelfth", "th"), "eight": ("eighth", "th")}
SIGNS = {"minus": "-", "negative": "-", "plus": "+", "positive": "+"}
MONEY = {"pound": "£", "pounds": "£", "euro": "€", "euros": "€", "dollar": "$", "dollars": "$", "cent": "¢", "cents": "¢"}
KEPT = ".%$¢€£"
#: Entries of a spelling table that is sent to every task.
SPELLINGS = 20_000


def _lexicon() -> dict[str, tuple[str, int, str]]:
    """word: (kind, amount, what follows its digits)."""
    found: dict[str, tuple[str, int, str]] = {w: ("zero", 0, "") for w in ZEROS} | {"zeroth": ("unit", 0, "th")}
    for n, w in enumerate(UNITS, 1):
        ordinal, ending = ODD_ORDINALS.get(w, (f"{w}th", "th"))
        found |= {w: ("unit", n, ""), "sixes" if w == "six" else f"{w}s": ("unit", n, "s"), ordinal: ("unit", n, ending)}
    for n, w in enumerate(TENS, 2):
        found |= {w: ("ten", 10 * n, ""), f"{w[:-1]}ies": ("ten", 10 * n, "s"), f"{w[:-1]}ieth": ("ten", 10 * n, "th")}
    for n, w in [(100, "hundred"), *((1000**k, w) for k, w in enumerate(SCALES, 1))]:
        found |= {w: ("scale", n, ""), f"{w}s": ("scale", n, "s"), f"{w}th": ("scale", n, "th")}
    return found


LEXICON = _lexicon()
# How written numbers stand beside letters, endings and money, and what is said for a half.
DIGITS = re.compile(r"\d+(\.\d+)?\Z")
HALF = ["and", "a", "half"]
APART = [(re.compile(r"([a-z])([0-9])"), r"\1 \2"), (re.compile(r"([0-9])([a-z])"), r"\1 \2"), (re.compile(r"([0-9])\s+(st|nd|rd|th|s)\b"), r"\1\2")]
WHOLE, CENTS, LESS_THAN_ONE = re.compile(r"[€£$]\d+"), re.compile(r"¢(\d{1,2})"), re.compile(r"[€£$]0\.(\d{1,2})")
ALONE = re.compile(r"\b1(s?)\b")
MARKS = "-+£€$¢"


class Token(NamedTuple):
    """A word and what it is in a number: `kind` is zero, unit, ten, scale, digits, point, repeat, sign, money, percent, link or word."""

    kind: str
    word: str
    amount: int = 0
    ending: str = ""


#: Kinds that carry a number on, and those that may follow a sign, a link, `point` or `double`.
BODY = {"zero", "unit", "ten", "scale", "digits", "point", "repeat"}
NUMERIC = {"zero", "unit", "ten", "scale", "digits", "sign", "money", "percent", "and", "double", "triple", "point", "per"}


@lru_cache(1 << 16)
def _kind_of(word: str) -> Token:
    """A word on its own."""
    if word in LEXICON:
        kind, amount, ending = LEXICON[word]
        return Token(kind, word, amount, ending)
    if DIGITS.match(word[1:] if word[0] in MARKS else word):
        return Token("digits", word)
    if word in SIGNS or word in MONEY:
        return Token("sign" if word in SIGNS else "money", word)
    return Token(word if word in ("and", "double", "triple", "point", "percent", "per") else "word", word)


def typed(words: list[str]) -> list[Token]:
    """The tokens of a text: words whose part depends on their neighbours are settled here, once.

    A half after a spelled-out number is its decimal place; after another word it stays as it is said, and with nothing before it, or
    but another half, it says nothing.
    """
    raw, out, skip, halved = [_kind_of(w) for w in words], [], 0, True
    for i, t in enumerate(raw):
        if skip:
            skip -= 1
            continue
        if t.kind == "and" and words[i : i + 3] == HALF:
            before, skip = raw[i - 1] if i else None, 2
            if not halved:
                counted = before.kind in ("zero", "unit", "ten", "scale") and not before.ending
                out += [Token("point", "point"), Token("unit", "five", 5)] if counted else [Token("word", w) for w in HALF]
            halved = True
            continue
        halved = False
        if t.kind == "word":
            out.append(t)
            continue
        ahead = raw[i + 1] if i + 1 < len(raw) else Token("end", "")
        numeric = ahead.kind in NUMERIC and not (ahead.kind == "digits" and ahead.word[0] in MARKS)
        plain = ahead.kind if not ahead.ending else ""
        if t.kind == "sign" and not numeric:
            t = t._replace(kind="word")
        elif t.kind == "per":
            skip = int(ahead.word == "cent")
            t = Token("percent", "per cent") if skip else t._replace(kind="word")
        elif t.kind == "and":
            joins = numeric and i > 0 and raw[i - 1].kind == "scale" and not raw[i - 1].ending
            t = t._replace(kind="link" if joins else "word")
        elif t.kind == "point" and numeric:
            t = t if plain in ("zero", "unit", "ten", "digits") else t._replace(kind="link")
        elif t.kind in ("double", "triple") and numeric and plain in ("zero", "unit"):
            t, skip = Token("repeat", f"{ahead.amount}" * (2 if t.kind == "double" else 3)), 1
        elif t.kind in ("point", "double", "triple"):
            t = t._replace(kind="word")
        out.append(t)
    return out


@dataclass
class Numeral:
    """A number as it is said: its digits so far, `set` once they stand side by side and are no longer a sum."""

    digits: str = ""
    set: bool = False
    last: str = ""

    @property
    def open(self) -> bool:
        """Whether decimal places, or the next part of an address, may follow."""
        return self.digits.endswith(".")

    def _beside(self, digits: str) -> None:
        self.digits, self.set = self.digits + digits, True

    def add(self, t: Token) -> None:
        """One more token: it fills the zeros at the end of a sum (twenty, one hundred), else it stands beside what was said."""
        if self.digits == "0" and not self.set and t.kind not in ("scale", "digits", "link"):
            self.digits = ""  # a written 0 is filled like any zero
        if t.kind == "scale":
            self._scale(t.amount)
        elif t.kind in ("unit", "ten"):
            width = 1 if t.amount < 10 else 2
            after_ten = width == 1 and self.last == "ten"
            room = self.digits.endswith("0" * width) and not self.set and not (t.kind == "unit" and self.last == "unit")
            if not self.digits:
                self.digits = str(t.amount)
            elif after_ten or room:
                self.digits = self.digits[:-width] + str(t.amount).zfill(width)
            else:
                self._beside(str(t.amount))
        elif t.kind == "digits" and not self.digits:
            number = Fraction(t.word)
            self.digits, self.set = (str(number.numerator), False) if number.denominator == 1 else (t.word, True)
        elif t.kind != "link":
            self._beside({"zero": "0", "point": "."}.get(t.kind, t.word))
        self.last = "" if t.ending else t.kind

    def _scale(self, amount: int) -> None:
        if not self.digits:
            self.digits = str(amount)
        elif self.set:
            self.digits, self.set = str(self._scaled(amount)), False
        else:
            thousands, rest = divmod(int(self.digits), 1000)
            self.digits = str(thousands * 1000 + rest * amount)

    def _scaled(self, amount: int) -> int | None:
        """What stands side by side, times a scale; null where that is no whole number."""
        try:
            product = Fraction(self.digits) * amount
        except ValueError:  # several points
            return None
        return product.numerator if product.denominator == 1 else None

    def takes(self, t: Token) -> bool:
        """Whether the token carries this number on; if not it starts the next one."""
        if t.kind == "digits":
            return not self.digits or self.open
        if t.kind == "scale" and self.set:
            return self._scaled(t.amount) is not None
        return True


def read_numbers(words: list[str]) -> list[str]:
    """The words with spelled-out numbers as digits, signs and currency before them, endings and percent after."""
    out: list[str] = []
    now, sign = Numeral(), ""

    def close(before: str | None = None, after: str = "") -> None:
        nonlocal now, sign
        if now.digits:
            out.append(f"{sign if before is None else before}{now.digits}{after}")
            sign = ""
        now = Numeral(last=now.last)

    for t in typed(words):
        if t.kind == "word" and not now.digits and not sign:
            out.append(t.word)
            now.last = "" if t.ending else t.kind
            continue
        if t.kind in BODY:
            if not now.takes(t):
                close()
            if t.kind == "digits" and not now.digits and t.word[0] in MARKS:
                sign, t = t.word[0], t._replace(word=t.word[1:])
            now.add(t)
            if t.ending:
                close(after=t.ending)
        elif t.kind == "sign":
            close()
            sign = SIGNS[t.word]
        elif t.kind in ("money", "percent") and now.digits:
            close(*((MONEY[t.word],) if t.kind == "money" else (None, "%")))
        elif t.kind != "link":
            close()
            out += [f"{sign}{w}" if not i else w for i, w in enumerate(t.word.split())]
            sign = ""
        now.last = "" if t.ending else t.kind
    close()
    return out


def with_cents(words: list[str]) -> list[str]:
    """Whole money and the cents said after it, with `and` between or not, as one sum; sums under one as cents."""
    out: list[str] = []
    for w in words:
        cents, back = CENTS.fullmatch(w), 2 if out[-1:] == ["and"] else 1
        if cents and len(out) >= back and WHOLE.fullmatch(out[-back]):
            w = f"{out[-back]}.{int(cents[1]):02d}"
            del out[-back:]
        less = LESS_THAN_ONE.fullmatch(w)
        out.append(f"¢{int(less[1])}" if less else w)
    return out


def numbers_as_digits(text: str) -> str:
    for pattern, to in APART:
        text = pattern.sub(to, text)
    return ALONE.sub(r"one\1", " ".join(with_cents(read_numbers(text.split()))))


def english_normal(c: Column, spellings: dict[str, str] | None = None) -> Column:
    """`c` in the form in which transcripts are compared. `spellings` maps words to the spelling to use; null stays null."""
    table = dict(spellings or {})
    if len(table) > SPELLINGS:
        raise ValueError(f"a spelling table has at most {SPELLINGS} entries")

    @F.udf(returnType=StringType(), useArrow=False)
    def numbered(t: str | None) -> str | None:
        return None if t is None else " ".join(table.get(w, w) for w in numbers_as_digits(bare(t, KEPT)).split())

    steps = [*BRACKETS, (FILLERS, ""), (r"\s+'", "'"), *REWRITES, (r"(\d),(\d)", "$1$2"), (r"\.([^0-9]|$)", " $1")]  # fixed values, as those below
    text = F.lower(c)
    for pattern, to in steps:
        text = F.regexp_replace(text, f"(?U){pattern}", to)
    text = numbered(text)
    for pattern, to in [(r"[.$¢€£]([^0-9])", " $1"), (r"([^0-9])%", "$1 "), (r"(?U)\s+", " ")]:
        text = F.regexp_replace(text, pattern, to)
    return text
