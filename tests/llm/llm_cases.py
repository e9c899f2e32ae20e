"""Small tables with awkward rows, and plain versions of the operators to compare with."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `a.b` string, node int, _row int, kept boolean"


def _prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghinorstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def documents(spark, extra=()):
    """Prose with copies, near copies and shared passages; nulls, empty and long texts, repeated rows and ids."""
    rng = random.Random(7)
    rows = []
    passage = _prose(rng, 70)
    for i in range(60):
        text = _prose(rng, rng.randint(60, 200))
        rows.append((i, text))
        if i % 6 == 0:
            rows.append((1000 + i, text))
        if i % 5 == 0:
            words = text.split()
            words[rng.randrange(len(words))] = "changed"
            rows.append((2000 + i, " ".join(words)))
        if i % 7 == 0:
            rows.append((3000 + i, _prose(rng, 60) + "\n" + passage + "\n" + _prose(rng, 50)))
    group = _prose(rng, 150).split()
    for i in range(40):
        words = list(group)
        words[i * 3] = f"edit{i}"
        rows.append((4000 + i, " ".join(words)))
    rows += [
        (5000, None),
        (5001, ""),
        (5002, " \n\t "),
        (5003, "four words only here"),
        (5004, "Four WORDS only here"),
        (5005, "ééé " * 300),
        (5006, "a" * 20_000),
        (5007, _prose(rng, 30_000)),
        (5008, "same row"),
        (5008, "same row"),
        (5009, "one id"),
        (5009, _prose(rng, 80)),
        (None, _prose(rng, 90)),
        (None, None),
        (5010, "# $ % & * | < > ! " * 40),
        (5011, "Released under the MIT License.\n" + _prose(rng, 60) + " gnu General public LICENSE"),
        (5012, "x\x1cy z w 😀 don't I'LL 中文字 ½² <|endoftext|> \r\n\n  end"),
    ]
    rows += list(extra)
    langs = ["en", "de", None]
    full = [
        (key, text, langs[i % 3], f"src{i % 4}" if i % 9 else None, len(text or ""), "x", 1, 2, True)
        for i, (key, text) in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None) -> frozenset:
    words = WORD.findall(lowered(text))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def components(texts: list[tuple[int | None, str | None]]) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of every row, all pairs compared."""
    sets = [shingles(t) for _, t in texts]
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least: dict[int, int | None] = {}
    for i, (key, _) in enumerate(texts):
        old = least.setdefault(root(i), key)
        least[root(i)] = old if key is None else key if old is None else min(old, key)
    return [(key, len(sets[i]), least[root(i)]) for i, (key, _) in enumerate(texts)]


def removed(texts: list[tuple[int | None, str | None]], depth: int = 200) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    rows = [(key, (text or "").encode()) for key, text in texts]
    seen = Counter(b[i : i + depth] for _, b in rows for i in range(len(b) - depth + 1))
    out = []
    for key, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if seen[b[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((key, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def base_rules(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {p + k for at in windows.values() if len(at) > 1 for p in at for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def base_licences(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    at = [
        (i, label)
        for phrase, label in PHRASES.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def licence_labels(text: str | None, templates: list[tuple[str, str, str]], least: float, common: set[str], near: int) -> tuple[str, float]:
    """Labels and score: every template laid at every place. A common word counts near a rarer one of any template."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    rare = {w for _, template, _ in templates for w in template.split()} - common
    counts = [w in rare or any(x in rare for x in words[max(0, i - near) : i + near + 1]) for i, w in enumerate(words)]
    base = base_licences(text)[4]
    labels, score = {x for x in base.split(",") if x}, 1.0 if base else 0.0
    for label, template, phrase in templates:
        want, key = template.split(), phrase.split()
        inner = next(i for i in range(len(want)) if want[i : i + len(key)] == key)
        for at in range(-len(want) + 1, len(words)):
            start = at + inner
            if start < 0 or words[start : start + len(key)] != key:
                continue
            share = sum(0 <= at + q < len(words) and counts[at + q] and words[at + q] == w for q, w in enumerate(want)) / len(want)
            if share >= least:
                labels.add(label)
                score = max(score, share)
    return ",".join(sorted(labels)), score
