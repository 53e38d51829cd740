"""Small documents with what the operators must stand: nulls, empty and long texts, repeats, clashing columns."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double"


def sentence(r: random.Random, n: int, words: list[str]) -> str:
    return " ".join(r.choice(words) for _ in range(n)).capitalize() + "."


def vocabulary(r: random.Random, parts: list[str], n: int = 300) -> list[str]:
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n)]


def documents(seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    en = vocabulary(r, ["th", "er", "on", "an", "ing", "re", "nd", "st"]) + ["the", "of", "and", "to"] * 40
    de = vocabulary(r, ["sch", "ung", "ein", "ich", "ver", "keit", "zu", "ge"]) + ["der", "die", "und", "das"] * 40
    out = []
    for i in range(60):
        words, lang = (en, "en") if i % 3 else (de, "de")
        text = "\n".join(sentence(r, r.randint(8, 40), words) for _ in range(r.randint(1, 6)))
        out.append((i, text, lang, f"s{i % 4}"))
    base = out[1][1]
    out.append((100, base, "en", "s1"))  # a copy
    out.append((101, base + " " + "tail", "en", "s1"))
    ws = base.split(" ")
    if len(ws) > 3:
        ws[2] = "changed"
    out.append((102, " ".join(ws), "en", None))
    out.append((103, None, None, None))
    out.append((104, "", "en", "s0"))
    out.append((105, "   \n\t ", "en", "s0"))
    out.append((106, "12345 !!", "en", "s0"))
    out.append((107, "One two", "en", "s0"))
    out.append((108, "ONE two", "en", "s0"))
    out.append((109, "word " * 3000, "en", "s2"))
    out.append((110, "\n".join([base] * 3), "en", "s2"))
    out.append((None, sentence(r, 30, en), "en", "s3"))
    out.append((7, out[7][1], "en", out[7][3]))  # a repeated row
    return [(i, t, g, s, len(t) if t is not None else None, -1, -1.0) for i, t, g, s in out]
