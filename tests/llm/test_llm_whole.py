"""Stand-ins beyond the number of surrogates, whole street names and page numbers with every digit misread."""

from tallyspan.llm import privacy, scans


def test_more_names_than_surrogates_all_get_one(spark):
    names = [chr(0x4E00 + i // 30) + chr(0x5E00 + i % 30) for i in range(700)]  # two characters have 576 surrogates
    events = spark.createDataFrame([(f"e{i}", f"联系人：{n}，请回复。") for i, n in enumerate(names)], "event_id string, content string")
    rows = privacy.contents(events, spark.createDataFrame([], "memory_id string, content string"))
    done = {r["record_id"]: r["content"] for r in privacy.redact(rows, frozenset(), "key", "surrogate").collect()}
    assert len(done) == 700 and len(set(done.values())) == 700
    assert not any(n in done[f"e{i}"] for i, n in enumerate(names))


def test_every_word_of_a_street_is_replaced():
    for text, words, kept in (("114a Mill Brook Avenue", ("Mill", "Brook"), "Avenue"), ("52 bis, chemin des Saulaies", ("Saulaies",), "bis, chemin des"), ("Am Birkenhof 3", ("Birkenhof",), "Am"), ("Lindenfelder Str. 12B", ("Lindenfelder",), "Str.")):
        made = privacy.surrogate("street_address", text, text.lower(), b"k")
        assert kept in made and not any(w in made for w in words), made


def test_page_numbers_with_every_digit_misread():
    body = [f"the auditor drew attention to supplier insurance {i} times." for i in range(8)]
    for line in ("– lO –", "- lO -", "[lO]", "lO/ll", "Page lO of ll"):
        _, places, shapes = scans.layout("\n".join([*body, line]))
        assert (places[-1], shapes[-1]) == ("B0", "num"), line
        assert scans.layout("\n".join([*body[:4], line, *body[4:]]))[2][4] != "num", line
    for line in ("lO", "Oil", "SOLO", "- and -", "[lost]", "p and l"):
        assert scans.layout("\n".join([*body, line]))[2][-1] != "num", line
