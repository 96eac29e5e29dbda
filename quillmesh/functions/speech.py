"""Text as it is read out: an ordered table of rewriting rules, all in the JVM.

A rule is a pattern and what takes its place; nothing is decided in code. Rules
of numbers leave decimals alone until the last of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.text import strip

Rule = tuple[str, str]

# Characters and what is read for them.
CHARACTERS = {"§": " section ", "‘": "'", "’": "'", "«": '"', "»": '"', "“": '"', "”": '"'}
# Written titles and how they are said; those in small letters count before a capital only where the flag says so.
TITLES = {"D[Rr]": ("Doctor", True), "Mr": ("Mister", False), "MR": ("Mister", True), "Ms": ("Miss", False), "MS": ("Miss", True), "Mrs": ("Mrs", False), "MRS": ("Mrs", True)}
# Currencies with their notes and coins, one and several.
CURRENCIES = {"$": ("dollar", "dollars", "cent", "cents"), "£": ("pound", "pounds", "penny", "pence")}
# Words for large amounts.
SCALES = ["hundred", "thousand", "million", "billion", "trillion"]

#: Letters, numbers and the underscore; zero and the digits above it, full-width ones too.
_WORD = r"[\p{L}\p{N}_]"
_ZERO, _DIGIT = "[0０]", "(?![0０])\\d"
_START, _END = rf"(?<!{_WORD})", rf"(?!{_WORD})"
#: Before a year: no part of a decimal or a word.
_FREE = r"(?<![\p{L}\p{N}_.])"
_AFTER_YEAR = rf"(?:(s){_END}|{_END}(?!\.\d))"
_CLOCK = r"(?<![\p{L}\p{N}_.:])([1-9]|1[0-2])"
#: Marks around the digits behind a point; noncharacters that no text has.
_OPEN, _SHUT = "﷐", "﷑"


def _titles() -> list[Rule]:
    return [(rf"{_START}{written}\.{'(?= [A-Z])' if before_capital else ''}", said) for written, (said, before_capital) in TITLES.items()]


def _times() -> list[Rule]:
    end = rf"{_END}(?!:)"
    return [(rf"{_CLOCK}:00{end}", "$1 o'clock"), (rf"{_CLOCK}:0([1-9]){end}", "$1 oh $2"), (rf"{_CLOCK}:([1-5]\d){end}", "$1 $2")]


def _years() -> list[Rule]:
    """Years from 1100 on but the first ten of a millennium: by hundreds, with oh, or in pairs."""
    return [
        (rf"{_FREE}({_DIGIT}{_DIGIT}){_ZERO}{_ZERO}{_AFTER_YEAR}", "$1 hundred$2"),
        (rf"{_FREE}({_DIGIT}{_DIGIT}){_ZERO}({_DIGIT}){_AFTER_YEAR}", "$1 oh $2$3"),
        (rf"{_FREE}({_DIGIT}{_DIGIT}|(?![1１]){_DIGIT}{_ZERO})({_DIGIT}\d){_AFTER_YEAR}", "$1 $2$3"),
    ]


def _money() -> list[Rule]:
    scale = rf"(?: (?i:{'|'.join(SCALES)}))+"
    rules = []
    for sign, (note, notes, coin, coins) in CURRENCIES.items():
        mark = rf"[{sign}]"
        rules.append((rf"{mark}(\d+(?:\.\d+)?{scale}){_END}", f"$1 {notes}"))
        for whole, said in ((r"(1)", note), (r"(\d+)", notes)):
            rules += [
                (rf"{mark}{whole}\.01{_END}", f"$1 {said} and 1 {coin}"),
                (rf"{mark}{whole}\.([1-9]){_END}", f"$1 {said} and $20 {coins}"),
                (rf"{mark}{whole}\.0+{_END}", f"$1 {said} and 0 {coins}"),
                (rf"{mark}{whole}\.0*(\d+){_END}", f"$1 {said} and $2 {coins}"),
                (rf"{mark}{whole}{_END}", f"$1 {said}"),
            ]
    return rules


def _decimals() -> list[Rule]:
    return [(r"(\d*)\.(\d+)", f"$1 point {_OPEN}$2{_SHUT}"), (rf"(?<=\d)(?=\d+{_SHUT})", " "), (f"[{_OPEN}{_SHUT}]", "")]


def _blanks() -> list[Rule]:
    return [(r"[^\S \n]", " "), ("  +", " ")]


RULES = [*_titles(), *_years(), *_times(), (r"(?<=\d),(?=\d)", ""), *_money(), *_decimals(), *_blanks()]


def speakable(text: Column) -> Column:
    """Text for a voice: titles, times, years, money and decimals in words; a list's number and signs in front dropped. Null stays null."""
    plain = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(CHARACTERS[c])), CHARACTERS, text)
    said = strip(reduce(lambda t, rule: F.regexp_replace(t, f"(?U){rule[0]}", rule[1]), RULES, plain))
    return strip(F.regexp_replace(F.regexp_replace(said, r"(?U)^\d+[.)]\s+", ""), "^[^a-zA-Z0-9]+", ""))
