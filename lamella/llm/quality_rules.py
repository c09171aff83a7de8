"""Quality rules, line first: lines that fail the rules are removed, then documents that lose too much text are rejected."""
from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lamella.llm.common import small_batches

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: Phrases that mark a short line as boilerplate, lower case.
BOILERPLATE = ("all rights reserved", "licensed under", "released under the", "terms of service", "terms of use", "privacy policy", "cookie policy",
               "use of cookies", "enable javascript", "subscribe to our newsletter", "lorem ipsum", "copyright ©", "powered by")
PHRASE = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, BOILERPLATE)) + r")(?!\w)")
#: Marks that end a sentence, by script; a colon or semicolon ends a line that goes on below.
ENDS = (".!?…‼‽⁇⁈⁉:;"        # Latin, Greek, Cyrillic
        "։"                  # Armenian
        "؟؛۔܀܁܂"              # Arabic, Urdu, Syriac
        "߹࠷࠽"                # N'Ko, Samaritan
        "।॥"                 # the scripts of India
        "๚๛།༎"              # Thai and Lao close, Tibetan
        "၊။។៕᪨᪩᭚᭛᭞᭟"         # Myanmar, Khmer, Tai Tham, Balinese
        "።፧፨᙮᠃᠉"             # Ethiopic, Canadian, Mongolian
        "᱾᱿꓿꘎꘏꣎꣏꤯꧈꧉꩝꩞꩟꫰꫱꯫"   # Ol Chiki, Lisu, Vai, Saurashtra, Kayah, Javanese, Cham, Meetei
        "﹒﹖﹗．：；")           # wide forms
#: Marks after which the next sentence may follow without a blank.
WIDE_ENDS = "。！？｡"
#: What may stand behind the mark.
CLOSERS = "\"'”’»›“‘)]}）］｝】〕》〉」』"
SENTENCE_END = re.compile(rf"[{re.escape(ENDS)}][{re.escape(CLOSERS)}]*(?:[ \t\r\xa0]|$)|[{WIDE_ENDS}]")
#: Thai, Lao and Khmer letters; these scripts part sentences by blanks.
UNMARKED = re.compile("[\u0e01-\u0e2e\u0e81-\u0eae\u1780-\u17b3]")
NAV_MARK = re.compile(r"(?<![^ \t])[|›»·•>/](?=[ \t]*(?:\S|$))")
#: A word with a run of symbols, or one that ends in two or more shouted marks.
NOISE = re.compile(r"^\S*[#*$%&|<>~^=_]{2,}\S*$|^\S*[!?]{2,}$|^[|#*$%&<>~^=_]+$")
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_words long, n_lines long, lost_lines long, clean_text string"


@dataclass(frozen=True)
class Rules:
    """Thresholds. ``max_lost``: share of all words that removed lines may hold, whichever rule they fail.

    A line is boilerplate if it has at most ``boilerplate_words`` words and phrases hold ``min_boilerplate`` of them.
    """
    min_words: int = 10
    max_repeat_pct: int = 20
    max_noise: float = 0.3
    nav_every: int = 6
    max_lost: float = 0.35
    boilerplate_words: int = 20
    min_boilerplate: float = 2 / 3


def line_fault(line: str, words: list[str], rules: Rules) -> str | None:
    """Which rule a line fails: ``boilerplate``, ``navigation``, ``punctuation``, or None. A blank line fails none.

    A line wants a sentence's end, in any script, unless a third of it is letters of scripts without such marks.
    """
    if not words:
        return None
    if len(words) <= rules.boilerplate_words:
        held = sum(len(m[0].split()) for m in PHRASE.finditer(" ".join(words).lower()))
        if held and held >= rules.min_boilerplate * len(words):
            return "boilerplate"
    # a closing quote is no mark
    marks = len(NAV_MARK.findall(line.replace("»", "") if "«" in line else line)) if any(c in line for c in "|›»·•>/") else 0
    if marks >= 2 and marks * rules.nav_every >= len(words) or marks and len(words) < rules.nav_every:
        return "navigation"
    if not SENTENCE_END.search(line) and 3 * len(UNMARKED.findall(line)) < sum(map(len, words)):
        return "punctuation"
    if any(c in line for c in "!?#*$%&|<>~^=_") and sum(1 for w in words if NOISE.match(w)) > rules.max_noise * len(words):
        return "punctuation"
    return None


def n_repeat_words(words: list) -> int:
    """Words inside 5-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - 4
    if n < 2:
        return 0
    seen: dict = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    with np.errstate(over="ignore"):
        mix = (ids + 1) * np.int64(-7046029254386353131)
        h = mix[:n].copy()
        for k in range(1, 5):
            h = h * np.int64(6364136223846793005) + mix[k:n + k]
    if len(np.unique(h)) == n:
        return 0

    def rank(a):
        return np.unique(a, return_inverse=True)[1].astype(np.int64)

    two = rank(ids[:-1] * len(seen) + ids[1:])
    four = rank(two[:-2] * len(two) + two[2:])
    _, which, count = np.unique(four[:n] * len(seen) + ids[4:], return_inverse=True, return_counts=True)
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(count[which] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + 5, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def judge(text: str | None, rules: Rules) -> tuple:
    """One row of ``SCHEMA``."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    lines = text.split("\n")
    seen: set[str] = set()
    dup = lost = counted = lost_lines = 0
    clean = []
    for line in lines:
        own = line.split()
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
        fault = line_fault(line, own, rules)
        counted += len(own)
        if fault is None:
            clean.append(line)
        else:
            lost_lines += 1
            lost += len(own)
    repeat = n_repeat_words(words)
    failed = n < rules.min_words or 100 * repeat > rules.max_repeat_pct * n
    kept = not failed and lost <= rules.max_lost * counted and counted > 0
    return (n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeat, failed, kept, lost, len(lines), lost_lines, "\n".join(clean))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules(), keep_columns: tuple = ()) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``keep_columns`` and the columns of ``SCHEMA``.

    A null or empty text has no words, fails the base rule and is not kept.  ``kept`` is false where ``base_failed``.
    Whole texts are read, one at a time; rows with a null id or repeated rows are judged like any other.
    """
    small_batches(docs.sparkSession)
    cols = list(dict.fromkeys([id_col, *keep_columns]))
    given = docs.select(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(cols)], docs[f"`{text_col}`"].alias("text"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            rows = [judge(t.as_py(), rules) for t in b.column("text")]
            out = {c: b.column(c) for c in b.schema.names[:-1]}
            for name, kind, vals in zip(names, SCHEMA.split(", "), zip(*rows) if rows else [()] * len(names)):
                t = kind.split()[1]
                out[name] = pa.array(vals, {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[t])
            yield pa.RecordBatch.from_pydict(out)

    head = ", ".join(f"c{i} {given.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(cols)))
    out = given.mapInArrow(run, f"{head}, {SCHEMA}")
    return out.select(*[out[f"c{i}"].alias(c) for i, c in enumerate(cols)], *names)
