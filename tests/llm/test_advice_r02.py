"""Cases of the second review."""

import hashlib
import random

import numpy as np
import pytest

from diamondlap.llm import chat, language_id, ngram_join, secret_scan


def han(seed, n, start, words=60):
    """Invented texts over 200 letters from code point `start` on."""
    rnd = random.Random(seed)
    vocabulary = ["".join(chr(start + rnd.randrange(200)) for _ in range(rnd.randint(1, 4))) for _ in range(40)]
    return [" ".join(rnd.choice(vocabulary) for _ in range(words)) for _ in range(n)]


# --- language ID -----------------------------------------------------------

def test_languages_that_differ_by_script_alone_are_told_apart(docs):
    """The second language is the first one with every letter 36 places further, or 360."""
    first = han(1, 30, 0x4E00)
    rows = [(k, t, "a") for k, t in enumerate(first)]
    for lang, shift in (("b", 36), ("c", 360)):
        rows += [(len(rows) + k, "".join(ch if ch == " " else chr(ord(ch) + shift) for ch in t), lang) for k, t in enumerate(first)]
    want = {r[0]: r[2] for r in rows}
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs(rows)).collect()} == want


def test_a_script_that_no_profile_holds_scores_nothing(table):
    profiles = language_id.learn(table("documents"))
    at = language_id.ranks(profiles)
    for text in ("Это русский текст о погоде и о людях", "ένα ελληνικό κείμενο", "هذا نص عربي", "这是一段中文", "これは日本語の文です", "한국어 문장"):
        assert language_id.nearest(text.encode(), list(profiles), at)[1] == 0


def test_n_grams_are_counted_in_full(docs, monkeypatch):
    """The profile is the same however often a task passes its counts on."""
    frame = docs([(k, t, "a") for k, t in enumerate(han(2, 40, 0x5000))])
    whole = language_id.learn(frame)
    found, count = np.unique(np.concatenate([language_id.grams(t.encode()) for t in han(2, 40, 0x5000)]), return_counts=True)
    assert list(whole["a"]) == [int(g) for _, g in sorted(zip(-count, found))[: language_id.PROFILE]]
    monkeypatch.setattr(language_id, "HELD", 10)
    assert list(language_id.learn(frame)["a"]) == list(whole["a"])


LONG_JUNK = {
    "gibberish": lambda rnd: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(500)),
    "gibberish words": lambda rnd: " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(80)),
    "mash": lambda rnd: "".join(rnd.choice("asdfjkl;ghqwe ") for _ in range(400)),
    "one letter": lambda rnd: "x" * 500,
    "hex": lambda rnd: "".join(rnd.choice("0123456789abcdef") for _ in range(1000)),
    "russian": lambda rnd: "Погода сегодня хорошая и люди гуляют по городу. " * 3,
    "greek": lambda rnd: "Ο καιρός είναι καλός σήμερα",
    "arabic": lambda rnd: "الطقس جميل اليوم",
    "chinese": lambda rnd: "今天天气很好人们在城里散步",
    "japanese": lambda rnd: "きょうはてんきがいいです",
    "finnish": lambda rnd: "tämä on suomenkielinen teksti joka kertoo säästä ja ihmisistä kaupungissa " * 2,
}


@pytest.mark.parametrize("labelled", [False, True])
def test_texts_far_from_every_language_go_and_clean_ones_stay(docs, table, labelled):
    """Planted among the documents, without a label and with a wrong one."""
    rnd = random.Random(5)
    own = [(r["doc_id"], r["text"], r["lang"]) for r in table("documents").collect()]
    junk = [(10_000 + k, make(rnd), "en" if labelled else None) for k, make in enumerate(LONG_JUNK.values())]
    clean = ["the", "of the and", "the cat sat on the mat", "le chat est sur la table", "der Mann und die Frau", "los de la casa"]
    clean = [(20_000 + k, t, None) for k, t in enumerate(clean)]
    kept = {r["doc_id"] for r in language_id.keep_identified(docs(own + junk + clean)).collect()}
    assert {d for d, t, _ in own if any(c.isalpha() for c in t or "")} <= kept
    assert {d for d, _, _ in clean} <= kept
    assert not {d for d, _, _ in junk} & kept


# --- secrets ---------------------------------------------------------------

KEY = "9fKx82LmQz7TnB4vR1pWc3Yd"
BASE64 = "kJ8s0QzL2mNv9XbT4rWcE7yH1uGdPaF6"
GLUED = [
    f"https://h.io/api/keys/{KEY}", f"auth_example={KEY}", f"x {BASE64}/ab/cd/{KEY} y", f"x {BASE64}abcdefghij{KEY} y",
    f"data/{KEY}", f"{KEY}_placeholder", f"/home/user/{KEY}/more/of/it", f"0123456789{KEY}xxxxxxxx{BASE64}",
]
HARMLESS = ["/usr/share/doc/Readme1", "this_is_an_Example1_of_a_key", "data/train/en/Part1", "xxxxxxxxxxxxxxxxxxxxxxxxA1b", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]


def test_keys_glued_to_listed_text_are_found(docs):
    rows = list(enumerate(GLUED + HARMLESS))
    found = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs(rows)).collect()}
    masked = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs(rows)).collect()}
    for k, text in rows:
        if text in HARMLESS:
            assert found[k] == "" and masked[k] == text
            continue
        assert "[SECRET]" in masked[k] and KEY not in masked[k] and BASE64 not in masked[k]
        spans = [(int(a), int(b)) for _, a, b in (x.split(":") for x in found[k].split(","))]
        for key in (KEY, BASE64):
            at = text.find(key)
            assert at < 0 or any(a <= at and at + len(key) <= b for a, b in spans)


# --- n-gram Jaccard join ---------------------------------------------------

def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_texts_that_share_an_id_are_judged_each(docs):
    base, clean, one, two, other = (prose(k, 60) for k in range(5))
    near = base + " and more"
    rows = [(1, base), (2, near), (2, clean), (5, one), (5, two), (7, other), (7, other), (8, "..."), (8, "!")]
    kept = sorted((r["doc_id"], r["text"]) for r in ngram_join.keep_one(docs(rows)).collect())
    assert kept == sorted([(1, base), (2, clean), (5, one), (5, two), (7, other), (8, "..."), (8, "!")])


def test_of_copies_without_id_one_stays(docs):
    base, alone = prose(1, 60), prose(2, 60)
    near = base + " and more"
    rows = [(None, base), (None, base), (None, near), (None, alone), (3, near), (4, base), (None, None), (None, "")]
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one(docs(rows)).collect()]
    assert (3, near) in kept and (None, alone) in kept and len(kept) == 5
    assert sum(d is None and t in (base, near) for d, t in kept) == 1


def test_which_of_equal_rows_stays_is_fixed(docs):
    text = prose(1, 60)
    for rows in ([(1, text), (1, text.upper())], [(1, text.upper()), (1, text)]):
        assert [r["text"] for r in ngram_join.keep_one(docs(rows)).collect()] == [text.upper()]


# --- chat ------------------------------------------------------------------

def test_loss_digest_follows_the_mask(spark):
    """Pieces whose mask covers other text than that of the role's."""
    rows = [(1, 0, "<|turn|>user\nab<\\c<|end|>\n", 0, 14, 17), (1, 1, "<|turn|>assistant\nxyz<|end|>\n", 25, None, None)]
    pieces = spark.createDataFrame(rows, "conv_id bigint, seq bigint, formatted string, start bigint, loss_start bigint, loss_end bigint")
    got = chat.digests(pieces).collect()
    whole = rows[0][2] + rows[1][2]
    assert [(r["n_turns"], r["loss_chars"], r["loss_sha256"]) for r in got] == [(2, 2, hashlib.sha256(chat.unescape(whole[14:17]).encode()).hexdigest())]
