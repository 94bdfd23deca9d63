"""Template residue, filler, error pages and script notices.

Two regularised logistic models on hashed n-grams, length and title features: one over sentences
(is this an unfilled placeholder or filler?), one over lines (is this an error message or script
notice?). Both learn from weak labels: response-status and phrase patterns, spread to the other
lines of a short page that carries one. They are fitted on a bounded sample of documents and
checked on sources left out of the fit. A document is residue if a sentence of it is a placeholder
or filler, or if a line is a notice and no line of it is content.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.encoding import chunks

#: Documents in the sample for the fit, about, and their longest; at most twice as many reach the driver (200 MB of characters, if all were as long).
SAMPLE, LONGEST = 12_000, 8_000
BITS, EPOCHS, LEAST_STEPS, RATE, RIDGE, SEED = 18, 12, 1500, 0.5, 1e-5, 7
#: One source in so many is left out of the fit for validation.
HOLD_OUT = 5
THRESHOLD = 0.5
#: Documents of the sample whose features are made at a time.
STRETCH = 500
#: Characters under which a page without a label is left out of the fit.
SHORT = 300
#: Tokens up to which a sentence is judged as one.
WIDE = 48

# Shapes of unfilled fields, by family.
SHAPES = [
    ("mustache", r"\{\{\s*\w[\w .]*\s*\}\}"), ("dollar", r"\$\{\s*\w+\s*\}"), ("tag", r"\{%\s*\w[^%{}\n]{0,40}%\}"), ("asp", r"<%=?\s*\w+\s*%>"), ("brackets", r"\[\[\s*\w+\s*\]\]"),
    ("angles", r"<<\s*\w+\s*>>"), ("entity", r"&lt;\s*\w+(?: \w+){0,3}\s*&gt;"), ("insert", r"<(?:insert|enter|add|your)\s[\w ]{1,40}>"), ("format", r"%\(\w+\)[sdf]"),
    ("percent", r"%[A-Z][A-Z_]{2,}%"), ("at", r"@@\w+@@"), ("under", r"__[A-Z][A-Z_]*__"), ("hash", r"#[A-Z][A-Z_]{2,}#"), ("brace", r"\{(?:\d|[a-z]\w*)\}"),
    ("square", r"\[(?:[A-Z][A-Z_]{2,}(?: [A-Z]+)*|(?:INSERT|Insert|insert|ENTER|Enter|YOUR|Your|ADD|Add) [\w ]{1,40}|[\w ]{2,40} (?:here|HERE|to come|TO COME|goes here|tbd))\]"), ("shell", r"\$[A-Z][A-Z_]{2,}\b\$?"), ("unknown", r"\bX{2,}[.,]X+\b%?|\[?\bTK\b\]?"),
]
# Phrases of filler, of talk about templates and errors, and of error pages and script notices.
FILLER = r"(?:text|copy|content|headline|subheading|title|body) (?:goes|comes) here|your (?:sub)?(?:headline|heading|title|text) here|(?:sample|dummy|filler) (?:copy|content|text)\b|add body copy|replace this (?:paragraph|text)|\btodo (?:write|add|check|insert)|\b(?:body|chart|quote) to come|\bx{3,} x{3,}|blindtext|platzhaltertext|texte provisoire|texto de (?:la noticia|muestra|relleno)|párrafo de muestra|ここに本文"
LOREM = r"\b(?:[Ll]orem|ipsum|dolor|amet|consectetur|adipiscing)\b"
TALK = r"\b(?:templates?|placeholders?|handbooks?|manuals?|guides?|documentation|fields?|markers?|variables?|macros?|scripts?|settings?|editors?|builders?|drafts?|tools?|software)\b"
NOTICE = (
    r"(?:^|\berror |\berreur |\bfehler |\bstatus\W{1,3})[45]\d\d\b.{0,40}(?:not found|bad gateway|gateway time|internal server|unavailable|forbidden|too many|unauthori|bad request|accès refusé|no pudo|nicht)"
    r"|page not found|not found on this server|something went wrong on our end|(?:enable|activate|turn on|allow) (?:java ?script|scripts)|java ?script is (?:disabled|off|turned off|required)|(?:site|page) requires (?:java ?)?scripts?|browser (?:blocks|has) script"
    r"|checking your browser|confirm you are human|session has expired|no longer available|access denied\. you|do not have permission|database connection|timed out while waiting|connection (?:was |has been )?(?:timed out|reset|refused)|nosuchkey|traceback \(most recent|too many requests|^noscript\b|client-side code is off"
    r"|javascript aktivieren|aktivieren sie javascript|activer javascript|active javascript|javascriptを有効|ページが見つかりません|seite nicht gefunden|página no encontrada|page introuvable|accès refusé|no pudo completar"
)

SHAPE = re.compile("|".join(f"(?P<{n}>{p})" for n, p in SHAPES))
TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*%?|_+|[^\w\s]")
#: Marks of ordinary sentences; runs of kinds with any other mark count MARKED times.
ORDINARY, MARKED = np.array([64 + ord(c) for c in ".,;:!?'\"()-/&…’‘“”„«»–—。、！？「」（）"]), 4
#: What every shape begins with, to look no further in most sentences.
QUICK = re.compile(r"[{\[<$@#&]|__|%[A-Z(]|TK|XX")
FILLER_RE, TALK_RE, NOTICE_RE = (re.compile(p, re.I) for p in (FILLER, TALK, NOTICE))
LOREM_RE = re.compile(LOREM)
ENDS = re.compile(r"[.!?。！？…\"”»)\]]\s*$")
SENTENCES = re.compile(r"(?<=[.!?。！？])(?=\s|[^\x00-\x7f])\s*")
LETTERS = re.compile(r"[^\W\d_]{2,}")
CJK = re.compile(r"[぀-ヿ一-鿿]{2,}")


def lines_of(text: str) -> list[str]:
    return [s for s in (x.strip() for x in re.split(r"[\r\n  ]+", text)) if s]


def sentences_of(line: str) -> list[str]:
    return [s for s in SENTENCES.split(line) if s and s.strip()]


@dataclass(frozen=True)
class Rows:
    """Hashed features of units: row k uses ``flat[start[k]:start[k + 1]]``."""

    flat: np.ndarray
    start: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1

    def take(self, rows: np.ndarray) -> Rows:
        n = np.diff(self.start)[rows]
        at = np.repeat(self.start[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        return Rows(self.flat[at], np.concatenate([[0], np.cumsum(n)]))


@dataclass(frozen=True)
class Units:
    """Sentences and lines of a batch of documents, with their features."""

    sentences: list[str]
    lines: list[str]
    sentence_doc: np.ndarray
    line_doc: np.ndarray
    sentence_rows: Rows
    line_rows: Rows


def _bucket(gram: str, known: dict[str, int]) -> int:
    h = known.get(gram)
    if h is None:
        h = zlib.crc32(gram.encode("utf-8", "surrogatepass")) | 1 << 32
        if len(known) < 500_000:
            known[gram] = h
    return h


def _grams(h: np.ndarray, unit: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, units) of the runs of ``n`` successive tokens inside a unit."""
    if len(h) < n:
        return h[:0], unit[:0]
    inside = unit[n - 1 :] == unit[: len(unit) - n + 1]
    x = np.full(len(h) - n + 1, salt, dtype=np.int64)
    for k in range(n):
        x = ((x ^ h[k : len(h) - n + 1 + k]) * 0x85EBCA77) & 0xFFFFFFFF
        x ^= x >> 13
    return x[inside], unit[n - 1 :][inside]


def _rows(h: np.ndarray, kinds: np.ndarray, unit: np.ndarray, extra: list[int], extra_unit: list[int], n: int) -> Rows:
    """Words and pairs of words, and runs of three and four kinds of tokens."""
    parts = [(h, unit), _grams(h, unit, 2, 1), (np.array(extra, dtype=np.int64), np.array(extra_unit, dtype=np.int64))]
    odd = (kinds >= 64) & ~np.isin(kinds, ORDINARY)
    # once as they are, and once with all odd marks alike, so that fields of shapes never seen look like those seen
    for size, of, salt in ((3, kinds, 3), (4, kinds, 4), (2, np.where(odd, 6, kinds), 5), (3, np.where(odd, 6, kinds), 6)):
        x, u = _grams(of, unit, size, salt)
        if len(x):
            marked = np.lib.stride_tricks.sliding_window_view(odd, size).any(axis=1)[unit[size - 1 :] == unit[: len(unit) - size + 1]]
            times = np.where(marked, MARKED, 1)
            parts.append((np.repeat(x, times), np.repeat(u, times)))
    every, owner = np.concatenate([x for x, _ in parts]), np.concatenate([u for _, u in parts])
    order = np.argsort(owner, kind="stable")
    start = np.searchsorted(owner[order], np.arange(n + 1))
    return Rows((every[order] & ((1 << BITS) - 1)).astype(np.int32), start)


def _kind(tok: str) -> int:
    """A mark stands for itself; words are lower, upper, capitalised, or other; digits are all alike."""
    if tok[0].isdigit():
        return 1
    if tok[0].isalpha():
        return 2 if tok.islower() else 3 if tok.isupper() and len(tok) > 1 else 4 if tok[0].isupper() else 5
    return 64 + ord(tok[0])


def pieces(line: str) -> Iterator[tuple[str, list[str]]]:
    """(text, tokens) of a line's sentences; a sentence of more than WIDE tokens comes in windows that overlap by half, so every part of it is judged."""
    for s in sentences_of(line):
        found = list(TOKEN.finditer(s))
        if len(found) <= WIDE:
            yield s, [m.group() for m in found]
            continue
        for k in range(0, len(found) - WIDE // 2, WIDE // 2):
            part = found[k : k + WIDE]
            yield s[part[0].start() : part[-1].end()], [m.group() for m in part]


def units(texts: list[str], titles: list[str | None], known: dict[str, int]) -> Units:
    """Hashed n-grams of words and of kinds of tokens, length and title features, of every sentence and line of a batch."""
    sents, lines, sdoc, ldoc = [], [], [], []
    hs, ks, hu, hl = [], [], [], []
    se, seu, le, leu = [], [], [], []
    for k, (text, title) in enumerate(zip(texts, titles)):
        head = title.strip().lower() if title else None
        for line in lines_of(text):
            lno, size = len(lines), 0
            for s, toks in pieces(line):
                if not toks:
                    continue
                sno = len(sents)
                hs += [known.get(x) or _bucket("9" if x[0].isdigit() else x.lower(), known) for x in toks]
                ks += [_kind(x) for x in toks]
                hu += [sno] * len(toks)
                hl += [lno] * len(toks)
                size += len(toks)
                more = [f"~len{min(len(toks).bit_length(), 7)}", "~ends" if ENDS.search(s) else "~open"]
                if not s.isascii():
                    more += [run[i : i + 3] for run in CJK.findall(s) for i in range(len(run) - 1)]
                if s.isupper():
                    more.append("~upper")
                got = [_bucket(g, known) for g in more]
                se += got
                seu += [sno] * len(got)
                le += got[2:]
                leu += [lno] * (len(got) - 2)
                sents.append(s)
                sdoc.append(k)
            more = [f"~len{min(size.bit_length(), 8)}", "~ends" if ENDS.search(line) else "~open"] + (["~title"] if head and line.lower() == head else [])
            le += [_bucket(g, known) for g in more]
            leu += [lno] * len(more)
            lines.append(line)
            ldoc.append(k)
    h, kinds = np.array(hs, dtype=np.int64), np.array(ks, dtype=np.int64)
    return Units(
        sents, lines, np.array(sdoc, dtype=np.int64), np.array(ldoc, dtype=np.int64),
        _rows(h, kinds, np.array(hu, dtype=np.int64), se, seu, len(sents)), _rows(h, kinds, np.array(hl, dtype=np.int64), le, leu, len(lines)),
    )


def weak_sentence(s: str) -> int:
    """1 for shapes of open fields, filler phrases, or mock Latin in lower case; -1 if two words tell that such a sentence is about the making of texts; else 0."""
    if not ((QUICK.search(s) and SHAPE.search(s)) or FILLER_RE.search(s) or len(LOREM_RE.findall(s)) >= 2):
        return 0
    return 1 if len({x.lower() for x in TALK_RE.findall(s)}) < 2 else -1


def weak_lines(lines: list[str], title: str | None) -> list[int]:
    """A notice phrase marks its line; on a short page it also marks the other closed lines."""
    hit = [bool(NOTICE_RE.search(x)) and len(x) < 260 for x in lines]
    short = sum(map(len, lines)) < 420 and any(hit)
    return [int(h or (short and bool(ENDS.search(x)) and x != title)) for h, x in zip(hit, lines)]


@dataclass(frozen=True)
class Linear:
    weights: np.ndarray
    bias: float

    def score(self, rows: Rows) -> np.ndarray:
        n = np.diff(rows.start)
        out = np.full(len(rows), self.bias)
        some = n > 0
        if some.any():
            out[some] += np.add.reduceat(self.weights[rows.flat], rows.start[:-1][some]) / np.sqrt(n[some])
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit_linear(rows: Rows, labels: np.ndarray) -> Linear:
    """L2-regularised logistic regression by AdaGrad; the rarer class weighs more, and as much so do units labelled -1, no cases that look like one. Constant without both classes."""
    y = (labels == 1).astype(float)
    w, g2, bias, gb = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8), 0.0, 1e-8
    if len(y) == 0 or y.min() == y.max():
        return Linear(w.astype("float32"), -9.0)
    rng = np.random.default_rng(SEED)
    weight = np.minimum(np.where(labels != 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())), 20.0)
    batches = max(1, len(rows) // 512)
    for _ in range(max(EPOCHS, LEAST_STEPS // batches)):
        for part in np.array_split(rng.permutation(len(rows)), batches):
            r = rows.take(part)
            m = np.diff(r.start)
            scale = 1 / np.sqrt(np.maximum(m, 1))
            z = np.bincount(np.repeat(np.arange(len(part)), m), w[r.flat], minlength=len(part)) * scale + bias
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * weight[part] / len(part)
            used, inv = np.unique(r.flat, return_inverse=True)
            grad = np.bincount(inv, np.repeat(err * scale, m), minlength=len(used)) + RIDGE * w[used]
            g2[used] += grad**2
            w[used] -= RATE * grad / np.sqrt(g2[used])
            gb += err.sum() ** 2
            bias -= RATE * err.sum() / np.sqrt(gb)
    return Linear(w.astype("float32"), float(bias))


def sample(docs: DataFrame, size: int = SAMPLE) -> pd.DataFrame:
    """About ``size`` documents of at most LONGEST characters, at most twice as many, chosen by hash of their id. Only the fit is bounded so; judged are all, whole."""
    d = docs.where(F.length("text") <= LONGEST).select("doc_id", "text", "title", "source")
    n = d.select("doc_id").count()
    if n > size:
        d = d.where(F.xxhash64("doc_id", F.lit(SEED)).cast("double") < size / n * 2.0**64 - 2.0**63).limit(2 * size)
    return d.toPandas()


@dataclass(frozen=True)
class Detector:
    sentence: Linear
    line: Linear

    def judge(self, texts: list[str], titles: list[str | None], known: dict[str, int]) -> tuple[list[str | None], np.ndarray]:
        """(kind, score) of each document: placeholder, notice or None."""
        u = units(texts, titles, known)
        ps, pl = self.sentence.score(u.sentence_rows), self.line.score(u.line_rows)
        top_s, top_l = np.zeros(len(texts)), np.zeros(len(texts))
        np.maximum.at(top_s, u.sentence_doc, ps)
        np.maximum.at(top_l, u.line_doc, pl)
        # exact check of a notice: no line is content, that is closed or tabular and no notice itself
        content = np.zeros(len(texts), dtype=bool)
        for k in np.flatnonzero((top_l[u.line_doc] >= THRESHOLD) & (pl < THRESHOLD)):
            x, title = u.lines[k], titles[u.line_doc[k]]
            if "\t" in x or (ENDS.search(x) and (title is None or x != title.strip())):
                content[u.line_doc[k]] = True
        kinds = ["placeholder" if a >= THRESHOLD else "notice" if b >= THRESHOLD and not c else None for a, b, c in zip(top_s, top_l, content)]
        return kinds, np.where(top_s >= THRESHOLD, top_s, top_l)


def _held_out(source: str | None) -> bool:
    return zlib.crc32((source or "").encode()) % HOLD_OUT == 0


def _joined(parts: list[Rows]) -> Rows:
    ends = np.cumsum([0, *(len(p.flat) for p in parts)])
    return Rows(np.concatenate([p.flat for p in parts]), np.concatenate([[0], *(p.start[1:] + e for p, e in zip(parts, ends))]))


def _training(rows: pd.DataFrame) -> tuple[Units, np.ndarray, np.ndarray]:
    """Units of the sample and their weak labels, made in stretches of documents, so that the driver holds one stretch's lists at a time."""
    known: dict[str, int] = {}
    got: list[tuple[Units, np.ndarray, np.ndarray]] = []
    for at in range(0, max(len(rows), 1), STRETCH):
        part = rows.iloc[at : at + STRETCH]
        titles = [t if isinstance(t, str) else None for t in part["title"]]
        u = units(part["text"].tolist(), titles, known)
        ys = np.array([weak_sentence(s) for s in u.sentences], dtype=float)
        yl = np.zeros(len(u.lines))
        cut = np.searchsorted(u.line_doc, np.arange(len(titles) + 1))
        for k, title in enumerate(titles):
            yl[cut[k] : cut[k + 1]] = weak_lines(u.lines[cut[k] : cut[k + 1]], title)
        got.append((Units(u.sentences, u.lines, u.sentence_doc + at, u.line_doc + at, u.sentence_rows, u.line_rows), ys, yl))
    us = [g[0] for g in got]
    every = Units(
        [s for u in us for s in u.sentences], [x for u in us for x in u.lines], np.concatenate([u.sentence_doc for u in us]), np.concatenate([u.line_doc for u in us]),
        _joined([u.sentence_rows for u in us]), _joined([u.line_rows for u in us]),
    )
    return every, np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])


def _told(u: Units, ys: np.ndarray, yl: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Documents that are labelled, or long enough to be taken for documents proper."""
    label = np.zeros(len(chars), dtype=bool)
    label[u.sentence_doc[ys == 1]] = True
    label[u.line_doc[yl == 1]] = True
    return label | (chars >= SHORT)


#: Families of open fields that the fit for the report never sees.
UNSEEN = frozenset({"dollar", "under", "square"})


def _families(text: str) -> set[str]:
    return {m.lastgroup for m in SHAPE.finditer(text)} if QUICK.search(text) else set()


def fit(docs: DataFrame, size: int = SAMPLE, unseen: frozenset[str] = frozenset()) -> tuple[Detector, dict[str, float]]:
    """The detector, and how it does on sources left out of the fit.

    With ``unseen`` documents with fields of these families are left out too, and the report says how many of those that
    have no other residue are found, and how many documents found in the held-out sources have a label or such a field.
    """
    rows = sample(docs, size)
    held = np.array([_held_out(s if isinstance(s, str) else None) for s in rows["source"]], dtype=bool)
    strange = np.array([bool(unseen & _families(t)) for t in rows["text"]] if unseen else np.zeros(len(rows)), dtype=bool)
    u, ys, yl = _training(rows[~held & ~strange])
    # a short page without any label may be a kind of notice the phrases don't know: it teaches nothing
    known = _told(u, ys, yl, rows[~held & ~strange]["text"].str.len().to_numpy())
    s, ln = np.flatnonzero(known[u.sentence_doc]), np.flatnonzero(known[u.line_doc])
    det = Detector(fit_linear(u.sentence_rows.take(s), ys[s]), fit_linear(u.line_rows.take(ln), yl[ln]))
    v, vs, vl = _training(rows[held])
    report = {"fit_docs": float((~held & ~strange).sum()), "held_docs": float(held.sum())}
    for name, model, x, y in (("sentence", det.sentence, v.sentence_rows, vs), ("line", det.line, v.line_rows, vl)):
        got = model.score(x) >= THRESHOLD
        hit = float((got & (y == 1)).sum())
        report |= {f"{name}_precision": hit / max(1.0, float(got.sum())), f"{name}_recall": hit / max(1.0, float((y == 1).sum())), f"{name}_positives": float((y == 1).sum())}
    if unseen and len(rows):
        w, ws, _ = _training(rows)
        labelled, other = np.zeros(len(rows), dtype=bool), np.zeros(len(rows), dtype=bool)
        for k, doc, text in zip(ws, w.sentence_doc, w.sentences):
            if k == 1:
                labelled[doc] = True
                other[doc] |= not unseen & _families(text)
        only = strange & labelled & ~other
        found = np.array([k is not None for k in det.judge(rows["text"].tolist(), [t if isinstance(t, str) else None for t in rows["title"]], {})[0]], dtype=bool)
        sentences = np.array([k == "placeholder" for k in det.judge(rows["text"].tolist(), [None] * len(rows), {})[0]], dtype=bool)
        report |= {"unseen_docs": float(only.sum()), "unseen_recall": float((found & only).sum()) / max(1.0, float(only.sum())), "unseen_precision": float((sentences & held & (labelled | strange)).sum()) / max(1.0, float((sentences & held).sum()))}
    return det, report


def _scorer(det: Detector) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for b in batches:
            texts, titles, ids = b["text"].tolist(), b["title"].tolist(), b["doc_id"].to_numpy()
            for at in chunks(texts):
                kinds, score = det.judge([t or "" for t in texts[at]], [t if isinstance(t, str) else None for t in titles[at]], known)
                yield pd.DataFrame({"doc_id": ids[at], "kind": kinds, "score": score})

    return run


def residue(docs: DataFrame, det: Detector) -> DataFrame:
    """(doc_id, kind, score) of the documents to keep out: kind is placeholder or notice.

    Null, empty and blank texts are no cases. Texts are judged whole, whatever their length. Repeated rows each give a
    row. A null title only leaves out the title features.
    """
    return docs.select(F.col("doc_id").cast("long"), "text", "title").mapInPandas(_scorer(det), "doc_id bigint, kind string, score double").where("kind is not null")
