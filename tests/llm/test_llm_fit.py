"""The line model of scanned pages is fitted on all of them."""

import random

import numpy as np

from tallyspan.llm import scans as sc

PAGE = "tenant_id string, user_id string, document_id string, page_number int, text string, extraction_method string, doc string, marks string"


def test_the_line_model_is_fitted_on_all_pages(spark, monkeypatch):
    fitted, fit = [], sc.fit_model

    def counted(pages, *args):
        fitted.append(pages.agg({"n": "sum"}).first()[0] if "n" in pages.columns else pages.count())
        return fit(pages, *args)

    monkeypatch.setattr(sc, "fit_model", counted)
    rows = [("t", "u", f"d{i // 50}", i % 50, f"Alpha Annual Report\n\n{'the auditor drew attention. ' * (i % 5)}\n- {i % 50} -", None, "", "") for i in range(5000)]
    headers = sc.found(spark.createDataFrame([*rows, *rows[:40]], PAGE)).where("noise_type = 'running_header'")
    assert fitted == [5040] and headers.count() == 5000


def test_pages_alike_count_as_often_as_they_are_there():
    draw = random.Random(5)
    codes = [np.asarray([draw.randrange(np.prod(sc._SIZES)) for _ in range(draw.randint(1, 30))], dtype="<u2") for _ in range(20)]
    times = [draw.randint(1, 4) for _ in codes]
    plain = [[sc._observation(c) for c in page] for page, n in zip(codes, times, strict=True) for _ in range(n)]
    (one, uses), (two, others) = (a := sc.Model()).expected(codes, times), (b := sc.Model()).expected(plain)
    assert np.allclose(one, two) and all(np.allclose(uses[c], others[b._codes[o]]) for o, c in a._codes.items())
    assert sc.Model().decode(codes) == sc.Model().decode([[sc._observation(c) for c in page] for page in codes])
