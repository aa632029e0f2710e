"""Problems 8, 9 and 10."""

import os

import numpy as np
import pytest

from codeloom.llm.mixture import flight, mix_sources, mixture_report, settle
from codeloom.llm.residue import classify, has_slot, masked, residue, unquoted
from codeloom.llm.tokens import Encoder, count_tokens, encode_texts, vocabulary_path

needs_vocabulary = pytest.mark.skipif(not os.path.isfile(vocabulary_path()), reason="no vocabulary here")
TEXTS = [None, "", " ", "Hello world, it's  fine\n\n\tx  ", "naïve façade — “quoted” … 索引 🚀👩‍💻", "<|endoftext|>", "a" * 5000, "1234567890 " * 300, "\x00\u2028nul\ufeff", "don't WE'LL we've"]


@needs_vocabulary
def test_ids_equal_reference_and_round_trip(spark):
    import base64

    import tiktoken

    from codeloom.llm.tokens import PRE_TOKEN

    with open(vocabulary_path(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    other = tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, TEXTS[3])], "doc_id long, text string").selectExpr("*", "1 as ids", "2 as __out")
    encoder = Encoder(vocabulary_path())
    rows = encode_texts(df.drop("__out"), "text").collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = TEXTS[r["doc_id"]]
        assert list(r["ids"]) == (other.encode_ordinary(text) if text else [])
        assert encoder.decode(list(r["ids"])) == (text or "")
    assert {r["doc_id"]: r["n_tokens"] for r in count_tokens(df.select("doc_id", "text"), "text").collect()}[0] == 0
    assert encode_texts(df.where("false").select("doc_id", "text"), "text").count() == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    p, size = rng.random(500), rng.integers(1, 400, 500).astype(float)
    done = flight(p, size, rng)
    assert ((done > 1e-9) & (done < 1 - 1e-9)).sum() <= 2
    assert abs(done.sum() - p.sum()) < 1e-6 and abs((done * size).sum() - (p * size).sum()) < 1e-4
    equal = flight(np.full(9, 1 / 3), np.ones(9), rng)
    assert abs(equal.sum() - 3) < 1e-9
    settled = settle(p, size, rng)
    assert set(settled) <= {0.0, 1.0} and abs((settled * size).sum() - (p * size).sum()) < 0.01 * (p * size).sum()


def test_mixture(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "big" if i % 3 else "small" if i % 2 else None, int(rng.integers(0, 200))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").selectExpr("*", "1 as p", "2 as chunk")
    weights = spark.createDataFrame([("big", 0.5, 3), ("small", 0.3, 2), ("none", 0.2, 5), ("big2", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixture, plan = mix_sources(df, weights)
    first = sorted(map(tuple, mixture.collect()))
    assert first == sorted(map(tuple, mix_sources(df, weights)[0].collect()))
    report = {r["source"]: r for r in mixture_report(mixture, plan).collect()}
    total = sum(n for _, s, n in rows if s)
    assert abs(report["big"]["tokens"] - 0.5 * total) < 0.01 * total
    assert abs(report["big"]["share_of_wanted"] - 0.5) < 0.01 < report["big"]["actual_share"] - 0.5
    assert report["small"]["most_repeats"] <= 2 and report["none"]["tokens"] == 0 and report["none"]["shortfall_tokens"] == round(0.2 * total)
    assert all(r[3] <= {"big": 3, "small": 2}[r[1]] for r in first) and "big2" not in report
    empty, plan = mix_sources(df.where("false"), weights)
    assert empty.count() == 0 and mixture_report(empty, plan).count() == 3


def test_mixture_in_rounds(spark, monkeypatch):
    from codeloom.llm import mixture as m

    rows = spark.range(3000).selectExpr("id as doc_id", "'s' as source", "1 + id % 90 as n_tokens", "0.37 as p")
    got = m.balanced_extra(rows, chunk_rows=200, reserve_rows=100).collect()
    assert len(got) == 3000 and len({r["doc_id"] for r in got}) == 3000
    assert abs(sum(r["extra"] * r["n_tokens"] for r in got) / sum(0.37 * r["n_tokens"] for r in got) - 1) < 0.01


RESIDUE = {
    "slot": ["Dear {{ user_name }}, welcome.", "See ${project} for it.", "Owner: <Team name>", "Run [insert summary here] first", "by %OWNER% on @@DATE@@", "the %(name)s job"],
    "error": ["404 Not Found", "Access denied\n\nContact your administrator.", "Zugriff verweigert. Bitte melden Sie sich an.", '{"error": {"code": 502, "message": "upstream x timed out"}}', "# Title\n\nOops! Something went wrong on our side."],
    "script": ["You need to enable JavaScript to run this app.", "Les scripts sont bloqués ; activez-les pour afficher la page.", "PLEASE ENABLE JAVASCRIPT TO VIEW THIS PAGE."],
    "filler": ["Lorem ipsum dolor sit amet.", "text text text text text", "Replace this text with a short description of your package."],
}
CLEAN = ["When the gateway answers 404 Not Found, the route is marked.", 'A user saw the text "Please enable JavaScript" in the output.', "The chart uses `{{ .Values.image }}` here.", "```\nexport A=${HOME}/x\nrun --repo <path>\n```\nfine", "> Access denied\n\nwas what they saw", "Demo pages contain lorem ipsum on purpose.", "See [the notes](docs/a.md#b) and [1] load it.", "", "   ", None, "[CLS] [SEP] <s></s>"]


def test_residue(spark):
    texts = [(kind, t) for kind, ts in RESIDUE.items() for t in ts] + [(None, t) for t in CLEAN]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)] + [(0, texts[0][1])], "doc_id long, text string").selectExpr("*", "1 as kind", "2 as n", "3 as head")
    got = {}
    for r in residue(df).collect():
        got.setdefault(r["doc_id"], set()).add(r["kind"])
    for i, (kind, _) in enumerate(texts):
        assert (kind in got.get(i, set())) if kind else i not in got, texts[i]
    assert residue(df.where("false")).count() == 0


def test_masking_and_rules():
    assert masked("- Error: could not fetch /a/b.go (status 404)", {}) == ["error", "could", "not", "fetch", "<*>", "status", "<*>"]
    assert classify("access denied") == "error" and classify("we agreed that an access denied message is clear") is None
    assert not has_slot(unquoted("`{{ x }}`")) and has_slot(unquoted("{{ x }}"))
    long = "word " * 200_000 + "{{ owner }}"
    assert has_slot(unquoted(long))


def test_segments_of_any_length_and_glued_ones():
    from codeloom.llm.residue import closed_vocabulary, descend, fits, templates_of

    long = "Something went wrong while we were trying " + " ".join(f"to load part {w} of the page" for w in "abcdef")
    assert len(long.split()) > 40
    found, _ = templates_of(long, {}, {})
    assert {classify(t) for t in found} == {"error"}
    for glued in ("tab\there\tand\thereService temporarily unavailable due to maintenance.", "索引は完了しましたPlease enable JavaScript to view this page.", "   many     blanks     Lorem ipsum dolor sit amet."):
        assert any(classify(t) for t in templates_of(glued, {}, {})[0]), glued
    assert not any(classify(t) for t in templates_of("The renderPage not found branch is gone.", {}, {})[0])
    nodes = {}
    assert descend("The deployment of lot failed because the migration was late.", {}, nodes) is None and len(nodes) < 6
    assert fits("something went") and not fits("something came")
    invented = ["Dolur sedum vorem elitra sitem temporis elitra nostra temporis amen.", "Quisque consecta temporis aliquan adipis magnis adipis amen dolur."]
    assert closed_vocabulary(invented) and closed_vocabulary(invented[:1])
    assert not closed_vocabulary(["Several independent reviewers rejected those proposals.", "Modern compilers produce faster programs every year."])
    assert not closed_vocabulary([])


def test_messages_that_begin_alike_keep_their_verdict(spark):
    rows = [(1, "Your browser does not support inline frames."), (2, "Your browser does not support our jokes any more today."), (3, "Connection reset by peer attempt 4"), (4, "Connection reset by admins attempt 4")]
    got = {r["doc_id"] for r in residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1, 2, 3}
