import random

from tallyspan.llm import scans as sc

PAGE = "tenant_id string, user_id string, document_id string, page_number int, text string, extraction_method string, doc string, marks string"
WORDS = "the auditor drew attention to supplier insurance permitting remaining commercial paper follows hedge accounting while demand from domestic market recovered sharply".split()


def corpus(noise):
    """Documents of five pages with a header, a footer with page number, and body lines; ``noise`` changes some lines."""
    draw, rows = random.Random(3), []
    for d in range(30):
        for p in range(1, 6):
            body = [" ".join(draw.choice(WORDS) for _ in range(8)) + "." for _ in range(12)]
            lines = [f"Company {chr(65 + d % 6)}lpha Annual Report", "", *body, "", "CREDIT QUALITY", "", *body[:3], f"- {p + 2} -"]
            rows.append(["t", "u", f"d{d}", p, lines])
    noise(rows)
    return [(t, u, d, p, "\n".join(lines), None, "clash", "clash") for t, u, d, p, lines in rows]


def test_planted_noise_is_found(spark):
    def plant(rows):
        rows[0][4][4] = "demand from the auditor recovered insur-"
        rows[0][4][5] = "ance follows the market."
        rows[1][4][6] = "the auditcr drew at†ention to 38.O% of cornmercial paper."
        rows[2][4][15:] = ["demand from domestic mar-", "- 5 -"]
        rows[3][4][2] = "ket recovered sharply."
        rows[4][4][3] = "between 2019-"
        rows[4][4][4] = "2021 demand recovered."

    rows = corpus(plant)
    got = {tuple(r) for r in sc.found(spark.createDataFrame([*rows, rows[0]], PAGE)).collect()}
    other = {r[2:] for r in got if r[5] in ("hyphen_break", "misread_char")}
    assert ("d0", 1, 5, "hyphen_break", "insurance") in other and ("d0", 5, 4, "hyphen_break", "2019-2021") in other
    assert {("d0", 2, 7, "misread_char", w) for w in ("attention", "38.0%", "commercial")} <= other
    assert ("d0", 3, 16, "hyphen_break", "market") in other
    headers = {(r[2], r[3]) for r in got if r[5] == "running_header"}
    numbers = {(r[2], r[3]) for r in got if r[5] == "page_number"}
    pages = {(d, p) for _, _, d, p, *_ in rows}
    assert len(headers & pages) >= 0.98 * len(pages) and len(numbers & pages) >= 0.98 * len(pages)
    assert not any(r[4] == 18 and r[5] == "running_header" for r in got)  # the heading inside the page stays


def test_nulls_blanks_and_empty_tables(spark):
    rows = [("t", "u", "d", 1, None, None, "", ""), ("t", "u", "d", 2, "", None, "", ""), (None, "u", "d", None, " \n ", None, "", ""), ("t", "u", "d", 3, "one line", None, "", "")]
    assert sc.found(spark.createDataFrame(rows, PAGE)).count() == 0
    assert sc.found(spark.createDataFrame([], PAGE)).count() == 0


def test_numbers_with_letters():
    assert [sc.clean_number(x) for x in ("38.O", "l8,849", "Z4.3%", "9S9.4", "2O23", "Q3", "38.0", "B", "10-K", "l", "202b", "Ab")] == ["38.0", "18,849", "24.3%", "959.4", "2023", None, None, None, None, None, "2026", None]


def test_a_misread_number_may_be_frequent(spark):
    rows = corpus(lambda rows: [r[4].__setitem__(3, "demand reguired 202l of the eﬀect") for r in rows[:9]] + [r[4].__setitem__(4, "it required the effect of 2021") for r in rows])
    got = sc.found(spark.createDataFrame(rows, PAGE)).where("noise_type = 'misread_char'")
    assert {r["repaired"] for r in got.collect()} >= {"2021", "effect", "required"} and got.where("repaired = '2021'").count() == 9


def test_text_comes_out_in_paragraphs(spark):
    rows = corpus(lambda rows: rows[0][4].__setitem__(slice(4, 6), ["demand from the auditor recovered insur-", "ance follows the market."]))
    text = next(r["text"] for r in sc.repaired_pages(spark.createDataFrame(rows, PAGE)).collect() if r["document_id"] == "d0" and r["page_number"] == 1)
    assert "Annual Report" not in text and "- 3 -" not in text and "recovered insurance follows the market." in text


def test_rebuilding_keeps_every_character_that_is_no_noise():
    page = "The (infor-\nmation), and more\n\nNEXT PART\n| a | 1 |\n| b | 2 |\nlast art of articles."
    assert sc.rebuilt(page, []) == "The (infor- mation), and more\nNEXT PART\n| a | 1 |\n| b | 2 |\nlast art of articles."
    got = sc.rebuilt(page, [(1, "hyphen_break", "information", "", ""), (7, "misread_char", "part", "art", "")])
    assert got == "The (information), and more\nNEXT PART\n| a | 1 |\n| b | 2 |\nlast part of articles."
    assert sc.rebuilt("costs of sup-\n\n- 7 -\npliers, then", [(1, "hyphen_break", "suppliers", "", ""), (3, "page_number", "", "", "")]) == "costs of suppliers, then"
    draw = random.Random(8)
    for _ in range(300):
        lines = ["".join(draw.choice("ab  .,()-|A1\t\n¬") for _ in range(draw.randint(0, 30))) for _ in range(draw.randint(1, 9))]
        text = "\n".join(lines)
        plain = lambda t: "".join(t.split())
        assert plain(sc.rebuilt(text, [])) == plain(text)
        gone = draw.randint(1, len(text.split("\n")))
        left = "\n".join(x for i, x in enumerate(text.split("\n"), 1) if i != gone)
        assert plain(sc.rebuilt(text, [(gone, "page_number", "", "", "")])) == plain(left)


def test_a_word_over_two_pages_comes_out_once(spark):
    def plant(rows):
        rows[2][4][15:] = ["demand from (domestic mar-", "- 5 -"]
        rows[3][4][2] = "ket), recovered sharply."
        rows[6][4][4:7] = ["the clearing commer-", "", "cial paper recovered."]

    rows = corpus(plant)
    got = {(r["document_id"], r["page_number"]): r["text"] for r in sc.repaired_pages(spark.createDataFrame([*rows, rows[2]], PAGE)).collect()}
    assert len(got) == 150
    assert got["d0", 3].endswith("demand from (domestic market),") and got["d0", 4].startswith("recovered sharply.")
    assert "the clearing commercial paper recovered." in got["d1", 2]


def test_two_misread_places_in_a_word(spark):
    rows = corpus(lambda rows: rows[1][4].__setitem__(6, "the audit0r permítting at†cntion recovered."))
    got = {r["repaired"] for r in sc.found(spark.createDataFrame(rows, PAGE)).where("noise_type = 'misread_char' and document_id = 'd0'").collect()}
    assert {"auditor", "permitting", "attention"} <= got


def test_the_line_model_learns_and_keeps_headers_at_any_place(spark):
    model, pages = sc.Model(), []
    for d in range(60):
        top = [("T0", "title", "rhi", "40", "off"), ("M", "blank", "", "0", "")] if d % 2 else [("T0", "text", "", "80", ""), ("T1", "text", "", "80", "")]
        pages.append([*top, *[("M", "text", "", "80", "")] * 9, ("M", "blank", "", "0", ""), ("B0", "num", "", "12", "off")])
    for _ in range(3):
        moves, uses = model.expected(pages)
        assert abs(sum(u.sum() for u in uses) - sum(map(len, pages))) < 1e-6 and abs(moves.sum() - sum(map(len, pages))) < 1e-6
        model = sc.Model.from_counts(moves, {o: uses[c] for o, c in model._codes.items()})
    # A header that stands deep in a page for once, and a title there that is none.
    deep = [*pages[0][:5], ("T4", "title", "rhi", "40", "off"), ("T5", "title", "sun", "40", "off"), *pages[0][5:], *[("M", "text", "", "80", "")] * 3]
    got = model.decode([pages[1], deep, []])
    assert got[0][0] == "header" and got[0][-1] == "number" and got[1][5] == "header" and got[1][6] != "header" and got[2] == []
