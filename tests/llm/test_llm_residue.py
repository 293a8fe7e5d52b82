import itertools
import os

import pytest

from tallyspan.llm import residue as rs

REAL = [f"Sales of {x} climbed by {i}.{i % 10} per cent in the {q} quarter, because freight surcharges were recovered." for i, (x, q) in enumerate((x, q) for x in ("rail wagons", "optical sensors", "cement additives", "bulk carriers") for q in ("first", "second", "third", "fourth") for _ in range(6))]
ABOUT = ["Visitors of the portal saw a 404 error for forty minutes, which the company blames on a certificate renewal.", "Cookie and biscuit sales recovered by 3.2%.", "Access to the data room was denied to one bidder, the trustee said.", "The builder swaps fields such as the company name for the real value."] * 6
BAD = ["Dear {{ name }}, please find enclosed the statement for ${ticker}.", "404 Not Found", "Please enable JavaScript to view this chart.", "Lorem ipsum dolor amet porta.", "Access denied.", "Your browser is not supported.", "Outlook: copy coming soon"] * 5
NOVEL = ["Dear %currency%, please find enclosed the statement for Fennick Holdings.", REAL[0] + " Please enable JavaScript to use this report.", "\n".join([*REAL[:9], "Fehler 503: Der Dienst antwortet nicht.", *REAL[9:14]])]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, score string")


def test_held_out_wordings(spark):
    texts = [*REAL, *ABOUT, *BAD, *NOVEL, None, "", " 　", REAL[1] * 3000, BAD[0]]
    got = sorted(r["doc_id"] for r in rs.found(frame(spark, texts)).collect())
    bad = range(len(REAL) + len(ABOUT), len(REAL) + len(ABOUT) + len(BAD) + len(NOVEL))
    assert got == [*bad, len(texts) - 1]
    assert rs.without_residue(frame(spark, texts)).count() == len(texts) - len(got)


def test_empty_and_one_sided_tables(spark):
    assert rs.found(frame(spark, [])).count() == 0 and rs.found(frame(spark, REAL[:5])).count() == 0
    assert rs.fit([]) == rs.fit([("sales of rail wagons climbed .", False, 3)]) and set(rs.fit([]).values()) == {rs.HIGHEST}


def test_no_phrase_decides_alone():
    assert rs.HIGHEST < rs.THRESHOLD
    scorer = rs.Scorer({f: 7.0 for p in rs.SEEDS for f in (p, *p.split(" "))})
    for phrase in rs.SEEDS:
        if phrase.count(" ") == 1:
            assert scorer.passage(["growth", *phrase.split(" "), "in", "the", "second", "half", "of", "the", "year"]) < rs.THRESHOLD


def test_wordings_that_no_phrase_names_are_learned(spark):
    """Wordings share trusted records with phrases in some documents and stand alone in others."""
    novel = ["That statement slipped away.", "Please switch on scripting and reload the viewer."]
    mixed = [f"{bad}\n{n}" for bad in BAD[:5] for n in novel for _ in range(3)]
    texts = [*REAL, *ABOUT, *mixed, *novel]
    got = {r["doc_id"] for r in rs.found(frame(spark, texts)).collect()}
    first = len(REAL) + len(ABOUT)
    assert got == set(range(first, len(texts)))


ORDINARY = [
    "In the most recent quarter revenue rose by 3%.", "Los costes no se modifican este trimestre.", "We don't have material exposure to the region.",
    "The plant has been moved to Ohio.", "Die Anleihe ist nicht mehr notiert.", "Access to the file was denied.", "We turn on the furnace in May.",
    "He could not connect the pipeline to the grid.", "The report could not be found by the auditor.", "Something went wrong at the smelter in March.",
]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the given tables")
def test_ordinary_sentences_and_seeds_held_out_on_the_given_tables(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    weights = rs.fit_model(documents)
    scorer = rs.Scorer(weights)
    assert all(scorer.text(x) < rs.THRESHOLD for x in ORDINARY)
    texts = [r["text"] for r in documents.where("text is not null").select("text").collect()]
    found = [t for t in texts if scorer.text(t) >= rs.THRESHOLD]
    unseeded = [t for t in found if not any(rs.is_trusted(rs._features(w)[0]) for w in rs.passages(t))]
    assert 3 * len(unseeded) >= len(found) > 600
    named = {f for p in rs.SEEDS for f in (*p.split(" "), *map(" ".join, itertools.pairwise(p.split(" "))))}
    held_out = rs.Scorer({f: w for f, w in weights.items() if f not in named or w < 0})
    assert sum(held_out.text(t) >= rs.THRESHOLD for t in found) >= 0.95 * len(found)
