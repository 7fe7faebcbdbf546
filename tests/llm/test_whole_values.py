"""What the reviewed operators once left out."""

import random
import string

import numpy as np
import pytest

from tessera.llm import decontaminate, secrets, toxicity


@pytest.mark.parametrize("text", ["login password: xK9#mQ2$vL", "auth token: xK9#mQ2$vL", "the password is token: xK9#mQ2$vL", "login password: bearer secret => xK9#mQ2$vL"])
def test_secret_behind_adjacent_keywords(text):
    assert [text[s:e] for s, e, _ in secrets.guessed_spans(text, secrets.base_spans(text))] == ["xK9#mQ2$vL"]


def test_secret_spans_and_costs_are_whole(spark):
    rng = random.Random(1)
    value = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(3_000))
    text = f"bearer {value} end"
    row = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["spans"] == "guess:7:3007" and row["top_log10_guesses"] == secrets.guess_cost(value) > secrets.guess_cost(value[:256]) + 1_000
    # A base span beyond what was once the cut leaves the value whole.
    text = f"bearer {value[:200]}-deadbeefdeadbeefdeadbeef0"
    assert secrets.guessed_spans(text, secrets.base_spans(text)) == [(7, len(text), "guess")]


def test_repeats_match_brute_force():
    rng = random.Random(2)
    for n in range(1, 160):
        block = "".join(rng.choice("ab") for _ in range(rng.randint(1, 40)))
        low = "".join(rng.choice((block, block[:17], "a", "c")) for _ in range(n))[:n]
        for e, found in enumerate(secrets._repeats(low), 1):
            assert sorted(int(s) for sizes in found for s in sizes) == [s for s in range(2, e // 2 + 1) if low[e - s : e] == low[e - 2 * s : e - s]]


def test_drop_contaminated_keeps_clean_rows_of_the_same_id(spark):
    leak = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(None, leak), (None, "clean words"), (None, None), (7, f"so {leak} so"), (7, "other words"), (8, leak)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, leak)], "item_id long, text string")
    kept = [tuple(r) for r in decontaminate.drop_contaminated(docs, benchmark).collect()]
    assert sorted(kept, key=str) == sorted([(None, "clean words"), (None, None), (7, "other words")], key=str)


def test_toxicity_learns_rare_markers():
    clean = [f"the house number {i} stands by the river and nobody is there" for i in range(500)]
    bad = [f"you are a worthless idiot number {i} by the river" for i in range(96)] + [f"the house number {i} zqvxkru stands by the river" for i in range(4)]
    model = toxicity.fit(clean + bad, [0] * 500 + [1] * 100)
    p = toxicity.scores(model, ["the house number 999 zqvxkru stands by the river", "the house number 999 stands by the river"])
    assert p[0] > 0.5 > p[1]


def test_toxicity_scores_a_passage_at_every_word(monkeypatch):
    monkeypatch.setattr(toxicity, "_PASSAGE", 3)
    assert list(toxicity._passages(6)) == [0, 1, 2, 3] and list(toxicity._passages(2)) == [0]
    model = toxicity.Model(np.zeros(toxicity._BUCKETS, np.float32), 0.0)
    (buckets, valid), first, _, _ = (lambda g: (g[0][0], *g[1:]))(toxicity.ngrams(["bad"]))
    model.logits[buckets[valid]] = 9.0
    # The three adjacent words start at an odd place, so only every-word starts see them together.
    low, high = toxicity.logits(model, ["so bad so bad so so", "so bad bad bad so so"])
    assert high > 2.9 * (low / 2) and high == toxicity.logits(model, ["bad bad bad so so so"])[0]


def test_toxicity_reads_words_together():
    rng = np.random.default_rng(0)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}o" for i in range(300)]
    fill = lambda n: " ".join(rng.choice(words, n))
    bad = [f"{fill(15)} hate you go home {fill(15)}" for _ in range(300)]
    # Half of the clean texts hold the same words, with others among them.
    clean = [f"{fill(15)} {'you can go home and we hate rain' if i % 2 else ''} {fill(15)}" for i in range(300)]
    model = toxicity.fit(bad[:200] + clean[:200], [1] * 200 + [0] * 200)
    assert (toxicity.scores(model, bad[200:]) >= 0.5).all()
    assert (toxicity.scores(model, clean[200:]) < 0.5).all()
