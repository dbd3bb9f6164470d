"""Languages of commit messages and of their segments, by cross-parsing.

A suffix automaton of labelled text per language gives, from any position of a
line, the longest match in that language; cutting the line greedily into such
matches, the language that needs the fewest phrases for its length wins.  The
phrase counts of the lines of a message enter a shortest path over lines in
which a change of language costs something, so that a line of one ambiguous
word goes with its neighbours.

The automata are fitted on a bounded sample of labelled rows
(``Fit.docs_per_language``, ``Fit.chars_per_document``,
``Fit.chars_per_language``).  As labels may be
wrong, a line of the sample is kept for its language only if the letter
trigrams of the whole sample, in which wrong labels are few, speak for that
language.  Every document is then labelled, its message as a whole.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes and English names of the languages the documents are written in.
LANGUAGES = {
    "en": ("eng", "english"), "de": ("deu", "ger", "german"), "fr": ("fra", "fre", "french"), "es": ("spa", "spanish", "castilian"),
    "pt": ("por", "portuguese"), "it": ("ita", "italian"), "nl": ("nld", "dut", "dutch", "flemish"), "pl": ("pol", "polish"),
    "ru": ("rus", "russian"), "ja": ("jpn", "japanese"),
}
FORMS = {f: code for code, forms in LANGUAGES.items() for f in (code, *forms)}
CODES = list(LANGUAGES)

TRAILER = re.compile(r"^(?:[A-Z][A-Za-z]*(?:-[A-Za-z]+)+: ?\S|(?:refs|fixes|closes|resolves|see-also|cc|bug|issue|link|change-id|see)\s*:\s*\S|git-svn-id:)", re.I)
PICKED = re.compile(r"^\(cherry[- ]picked from commit\b", re.I)
PREFIX = re.compile(r"^(?:\s*(?:\[[^\]]*\]|#\d+:?|wip\b:?|re:|(?:fix|feat|chore|docs?|refactor|tests?|ci|build|perf|style|revert)(?:\([^)]*\))?!?:))+", re.I)
CODE = re.compile(r"^(?:>>> |\.\.\. |\$ |#include\b|diff --git )|^[\w.\[\]]+\s*=\s*\S|[;{}]\s*$|^[\w.]+\([^)]*\);?$")
NAME = re.compile(r"[!-~]*[_/\\@=<>{}|0-9][!-~]*|'[^' ]*'|\"[^\" ]*\"|`[^`]*`|[!-~]+\(\)[!-~]*|[!-~]+\.[A-Za-z0-9][!-~]*")  # of ASCII only: some scripts do not separate words
LAYOUT_LOG = re.compile(r"^commit [0-9a-f]{7,64}\b")
LAYOUT_MAIL = re.compile(r"^From [0-9a-f]{7,64} ")


@dataclass(frozen=True)
class Fit:
    docs_per_language: int = 300  # labelled documents sampled for each language
    chars_per_document: int = 4_000  # of the lines of a sampled message, drawn from all of it, this many characters are kept
    chars_per_language: int = 24_000  # of their clean lines, this many characters are fitted
    shortest: int = 12  # characters of a line that is fitted
    margin: float = 2.0  # of the log likelihood by which a line must speak for its label to be fitted
    switch: float = 2.5  # phrases that a change of language costs within a paragraph
    switch_paragraph: float = 1.0  # and across a blank line
    sharpness: float = 1.2  # of the confidence


def canonical_label(label: Column) -> Column:
    """The two-letter code that a label names, in whatever form; null if it names none of ``LANGUAGES``."""
    text = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    code = F.create_map(*[F.lit(x) for pair in FORMS.items() for x in pair])
    return F.coalesce(F.try_element_at(code, text), F.try_element_at(code, F.regexp_extract(text, r"(?U)^[^-_\s]+", 0)))


def message_lines(text: str) -> list[tuple[int, str]]:
    """(line number, content) of the message of a commit; header, diff and indentation of the log layout are left out."""
    lines = text.split("\n")
    lines = [x[:-1] if x.endswith("\r") else x for x in lines]
    out: list[tuple[int, str]] = []
    i = 0
    if LAYOUT_LOG.match(lines[0]):
        while i < len(lines) and lines[i].strip():
            i += 1
        for j in range(i, len(lines)):
            if lines[j].startswith("    "):
                out.append((j, lines[j][4:]))
            elif not lines[j].strip():
                out.append((j, ""))
            else:
                break
    elif LAYOUT_MAIL.match(lines[0]):
        subject = False
        i = 1
        while i < len(lines) and lines[i].strip() and lines[i] != "---":
            if lines[i].lower().startswith("subject:"):
                subject = True
                out.append((i, lines[i][8:].strip()))
            elif subject and lines[i][:1] in " \t":
                out.append((i, lines[i].strip()))
            else:
                subject = False
            i += 1
        while i < len(lines) and lines[i] != "---" and not lines[i].startswith("diff --git "):
            out.append((i, lines[i]))
            i += 1
    else:
        while i < len(lines) and not lines[i].startswith("diff --git "):
            out.append((i, lines[i]))
            i += 1
    return out


def words_of(line: str) -> str:
    """The line's words, folded and single-spaced; '' if it belongs to no segment."""
    s = line.strip()
    quoted = False
    while s.startswith(">") and not s.startswith(">>>"):
        s, quoted = s[1:].strip(), True
    if not s or TRAILER.match(s) or PICKED.match(s) or CODE.search(s) or (line[:4] == "    " and not quoted and CODE.search(s)):
        return ""
    s = PREFIX.sub(" ", s)
    s = NAME.sub(" ", s)
    s = unicodedata.normalize("NFKD", s).lower()
    s = "".join(c if c.isalpha() else "" if unicodedata.combining(c) else " " for c in s)
    s = " ".join(s.split())
    return s if sum(map(len, s.split())) >= 2 else ""


class Automaton:
    """Suffix automaton that grows with its text; every substring of the text is a path from state 0."""

    def __init__(self, text: str = ""):
        self.go: list[dict] = [{}]
        self.link, self.length, self.last = [-1], [0], 0
        self.extend(text)

    def extend(self, text: str) -> None:
        go, link, length, last = self.go, self.link, self.length, self.last
        for ch in text:
            cur = len(go)
            go.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and ch not in go[p]:
                go[p][ch] = cur
                p = link[p]
            if p != -1:
                q = go[p][ch]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    twin = len(go)
                    go.append(dict(go[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and go[p].get(ch) == q:
                        go[p][ch] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        self.last = last

    def phrases(self, text: str) -> int:
        go, n, at = self.go, 1, 0
        for ch in text:
            to = go[at].get(ch)
            if to is None:
                n += at != 0
                to = go[0].get(ch)
                if to is None:
                    n += 1
                    to = 0
            at = to
        return n - (at == 0 and n > 1)

    def linked(self) -> dict:
        """The root of the finished automaton, its states being the dicts of their transitions."""
        for state in self.go:
            for ch, to in state.items():
                state[ch] = self.go[to]
        return self.go[0]


def phrases(root: dict, text: str) -> int:
    """Phrases of the greedy cross-parsing of ``text``; a character the language lacks is a phrase."""
    n, at = 1, root
    for ch in text:
        to = at.get(ch)
        if to is None:
            n += at is not root
            to = root.get(ch)
            if to is None:
                n += 1
                to = root
        at = to
    return n - (at is root and n > 1)


def fit(sample: list[tuple[str, str]], how: Fit) -> dict[str, str]:
    """Clean text per language from (language, message words by line) of labelled documents."""
    if not sample:
        return {}
    langs = sorted({lang for lang, _ in sample})
    lines = [(langs.index(lang), line) for lang, text in sample for line in text.split("\n")]
    index: dict[str, int] = {}
    grams = [[index.setdefault(padded[i : i + 3], len(index)) for i in range(len(padded) - 2)] for padded in (f" {line} " for _, line in lines)]
    of = np.repeat([k for k, _ in lines], [len(g) for g in grams])
    counts = np.zeros((len(index) + 1, len(langs)))
    np.add.at(counts, (np.fromiter((x for g in grams for x in g), np.int64, len(of)), of), 1.0)
    odds = np.log((counts + 0.1) / (counts + 0.1).sum(axis=0))
    kept: dict[str, list[str]] = {lang: [] for lang in langs}
    for (k, line), g in zip(lines, grams):
        if len(line) >= how.shortest:
            score = odds[g].sum(axis=0)
            mine = score[k]
            score[k] = -np.inf
            if mine > score.max() + how.margin:
                kept[langs[k]].append(line)
    return {lang: _novel(rows, how.chars_per_language) for lang, rows in kept.items() if rows}


def _novel(lines: list[str], most: int) -> str:
    """Up to ``most`` characters of those lines that the lines before do not cover in two phrases."""
    grown, out, size = Automaton(), [], 0
    for line in dict.fromkeys(lines):
        padded = f" {line} "
        if size + len(padded) <= most and grown.phrases(padded) > 2:
            grown.extend(padded + "\n")
            out.append(padded)
            size += len(padded) + 1
    return "\n".join(out)


_MODELS: dict[tuple, list[dict]] = {}  # automata of this worker


def _automata(texts: tuple[tuple[str, str], ...]) -> list[dict]:
    if texts not in _MODELS:
        _MODELS.clear()
        _MODELS[texts] = [Automaton(t).linked() for _, t in texts]
    return _MODELS[texts]


def segments_of(text: str, langs: list[str], roots: list[dict], how: Fit, memo: dict) -> list[tuple[int, int, str, float]]:
    """(first line, last line, language, confidence) of each segment of a message."""
    rows: list[tuple[int, list[float], bool]] = []
    blank = False
    for no, line in message_lines(text):
        if not line.strip():
            blank = True
            continue
        words = words_of(line)
        if not words:
            continue
        cost = memo.get(words)
        if cost is None:
            padded = f" {words} "
            cost = [phrases(r, padded) for r in roots]
            if len(memo) > 50_000:
                memo.clear()
            memo[words] = cost
        # a line that no language knows better than letter by letter has no words of a language
        if min(cost) > 0.5 * len(words) + 1:
            continue
        rows.append((no, cost, blank))
        blank = False
    if not rows:
        return []
    k = len(roots)
    best = list(rows[0][1])
    back: list[list[int]] = []
    for _, cost, apart in rows[1:]:
        change = how.switch_paragraph if apart else how.switch
        low = min(range(k), key=best.__getitem__)
        floor = best[low] + change
        step = [j if best[j] <= floor else low for j in range(k)]
        back.append(step)
        best = [min(best[j], floor) + cost[j] for j in range(k)]
    at = min(range(k), key=best.__getitem__)
    path = [at]
    for step in reversed(back):
        at = step[at]
        path.append(at)
    path.reverse()
    out: list[tuple[int, int, str, float]] = []
    i = 0
    while i < len(rows):
        j = i
        total = [0.0] * k
        while j < len(rows) and path[j] == path[i]:
            total = [a + b for a, b in zip(total, rows[j][1])]
            j += 1
        mine = total[path[i]]
        confidence = 1.0 / sum(math.exp(min(30.0, -how.sharpness * (t - mine))) for t in total)
        out.append((rows[i][0], rows[j - 1][0], langs[path[i]], confidence))
        i = j
    return out


LABELLED = "doc_id long, declared string, n_segments int, segment int, first_line int, last_line int, lang string, confidence double"


def _label(texts: tuple[tuple[str, str], ...], how: Fit):
    langs = [lang for lang, _ in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = _automata(texts)
        memo: dict = {}
        schema = pa.schema([("doc_id", pa.int64()), ("declared", pa.string()), ("n_segments", pa.int32()), ("segment", pa.int32()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for doc, text, declared in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = segments_of(text, langs, roots, how, memo) if text and langs else []
                for s, (a, b, lang, conf) in enumerate(found or [(None, None, None, None)]):
                    for c, x in zip(cols, (doc, declared, len(found), s if found else None, a, b, lang, conf)):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def _sample_lines(how: Fit):
    schema = pa.schema([("h", pa.int64()), ("lang", pa.string()), ("lines", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for h, text, lang in zip(*(batch.column(i).to_pylist() for i in range(3))):
                lines = [w for w in (words_of(x) for _, x in message_lines(text)) if w] if text else []
                if sum(map(len, lines)) > how.chars_per_document:
                    order = sorted(range(len(lines)), key=lambda i: zlib.crc32(f"{h} {i}".encode()))
                    upto = itertools.accumulate(len(lines[i]) for i in order)
                    lines = [lines[i] for i in sorted(i for i, n in zip(order, upto) if n <= how.chars_per_document)]
                if lines:
                    out.append((h, lang, "\n".join(lines)))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)

    return run


def below_share(h: Column, share: float) -> Column:
    """Whether a 64-bit hash falls into this share of its range, however small."""
    return F.lit(True) if share >= 1 else h < F.lit(int(share * 2.0**64) - 2**63)


def labelled_sample(documents: DataFrame, how: Fit, counts: dict[str, int] | None = None) -> list[tuple[str, str]]:
    """A bounded sample of documents whose label names a known language: (language, words by line).

    The share to draw follows from the number of documents labelled with each
    language (``counts``, at most one entry a language), so that what reaches
    the driver does not grow with the table.  A language of which nothing with
    words was drawn is drawn again from a larger share, at last from all its
    documents; documents without an id are told apart by their text.
    """
    known = documents.select("doc_id", "text", canonical_label(F.col("lang")).alias("code")).where("code IS NOT NULL")
    if counts is None:
        counts = {code: n for code, n in known.groupBy("code").count().collect()}
    shares = {code: min(1.0, 1.5 * how.docs_per_language / n) for code, n in counts.items() if n}
    head = F.substring_index("text", "\ndiff --git ", 1)
    by_lang: dict[str, list] = {}
    while shares:
        draw = F.lit(False)
        for code, share in shares.items():
            draw = draw | ((F.col("code") == code) & below_share(F.col("h"), share))
        hashed = known.withColumn("h", F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(7))).otherwise(F.xxhash64("doc_id", F.lit(7))))
        drawn = hashed.where(draw).select("h", head.alias("text"), "code").mapInArrow(_sample_lines(how), "h long, lang string, lines string")
        for h, lang, lines in drawn.collect():
            by_lang.setdefault(lang, []).append((h, lines))
        shares = {code: min(1.0, 64 * share) for code, share in shares.items() if code not in by_lang and share < 1}
    return [(lang, lines) for lang in sorted(by_lang) for _, lines in sorted(by_lang[lang])[: how.docs_per_language]]


def label_documents(documents: DataFrame, how: Fit = Fit()) -> DataFrame:
    """Segments of every document's message with language and confidence; a document without any has one row of nulls.

    ``documents`` has doc_id, text and lang; extra columns are ignored.  A null
    or empty text has no segment.  ``declared`` is the label's two-letter
    code, null if it names no known language.  Repeated rows are labelled each.  Without a
    labelled row nothing can be fitted, and no document has a segment.
    """
    texts = tuple(sorted(fit(labelled_sample(documents, how), how).items()))
    head = F.substring_index("text", "\ndiff --git ", 1)  # the message lies before the diff
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), head.alias("text"), canonical_label(F.col("lang")).alias("lang")).mapInArrow(_label(texts, how), LABELLED)


def mislabelled(labelled: DataFrame) -> DataFrame:
    """(doc_id, first_line, lang) of all segments of documents that are mixed, or whose label is missing or wrong."""
    wrong = F.col("declared").isNull() | (F.col("declared") != F.col("lang"))
    return labelled.where((F.col("n_segments") > 1) | ((F.col("n_segments") == 1) & wrong)).select("doc_id", "first_line", "lang").distinct()
