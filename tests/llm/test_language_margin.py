import random

from runlattice.llm import language


def test_long_texts_are_rejected_by_their_relative_margin():
    r = random.Random(4)
    words = {g: ["".join(r.choice(c) for _ in range(r.randint(3, 8))) for _ in range(400)] for g, c in (("aa", "abcdefghij"), ("bb", "klmnopqrst"))}
    text = lambda g, n: " ".join(r.choice(words[g]) for _ in range(n))
    judge = language.Judge({g: text(g, 3000).encode() for g in words})
    for g in words:
        assert judge(text(g, 40))[0::2] == judge(text(g, 2000))[0::2] == (g, False)
    junk = [" ".join("".join(r.choice("uvwxyz") for _ in range(r.randint(3, 8))) for _ in range(1500)) for _ in range(20)]
    got = [judge(t) for t in junk]
    assert all(rejected for _, margin, rejected in got if margin < language.MIN_MARGIN) and sum(x[2] for x in got) >= 19


def test_a_byte_apart_is_rejected(monkeypatch):
    judge = language.Judge({"aa": b"abc abd abe", "bb": b"xyz xyw xyv"})
    for sizes, rejected in (((5000, 5003), True), ((5000, 5100), False), ((20, 21), True), ((20, 23), False), ((30, 30), True)):
        monkeypatch.setattr(language, "_sizes", lambda text, packers, sizes=sizes: list(sizes))
        assert judge("abc")[2] is rejected
