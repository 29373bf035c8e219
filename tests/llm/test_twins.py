"""SQL twins on data where they have something to decide."""

from __future__ import annotations

import time

import duckdb
import pandas as pd

from ledgerlens.llm import url_rules
from ledgerlens.llm.oracles import ORACLES


def test_mined_url_rules_equal_sql(spark):
    rows = [(100 + i, f"http://spam-{i % 3}.example.org/{'shop' if i % 2 else 'news'}/{i}?a={i}&b") for i in range(120)]
    rows += [(300 + i, f"http://good-{i}.example.net/shop/{i}#x") for i in range(90)] + [(600, None), (601, "http://")]
    labels = [(100 + i, 1, int(i % 2 == 1)) for i in range(90)] + [(300 + i, int(i % 4 > 0), 0) for i in range(70)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = url_rules.judged_urls(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url"]))
    con.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]))
    want = con.execute(ORACLES["op4_url_rules"]).df()[list(got.columns)]
    plain = lambda f: sorted(map(tuple, f.astype(object).where(f.notna(), None).values.tolist()))
    assert plain(got) == plain(want) and got["mined"].notna().sum() > 60


def test_a_long_shared_path_is_one_item(spark):
    """60 labelled pages under one path of 18 segments: mined in seconds, with the same rules as token by token."""
    path = "/".join(f"part{chr(97 + k)}" for k in range(18))
    rows = [(i, f"http://a.example.org/{path}/{i}?x={i}") for i in range(60)] + [(100 + i, f"http://b{i}.example.net/parta/z") for i in range(60)]
    rows += [(900, "http://c.example.com/q/partc"), (901, "http://c.example.com/parta")]
    labels = [(i, 0, 1) for i in range(60)] + [(100 + i, 1, 0) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    started = time.time()
    got = {r["page_id"]: r for r in url_rules.judged_urls(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert time.time() - started < 60
    assert all(got[i]["verdict"] == "block" for i in range(60)) and all(got[100 + i]["verdict"] == "allow" for i in range(60))
    assert got[900]["mined"] == "p:partc" and got[901]["mined"] is None


def test_encoder_stays_right_while_it_forgets(monkeypatch, prose):
    import pyarrow as pa

    from ledgerlens.llm import common as C
    from ledgerlens.llm import repair

    monkeypatch.setattr(repair, "REMEMBERED", 60)
    encoder = repair.Encoder(repair.default_tokenizer())
    for k in range(12):
        texts = [prose(k % 3, 70), prose(100 + k, 40), "a b a b", "", None, "x <|endoftext|> y"]
        ids, sizes = encoder.encode(*C.text_bytes(pa.array(texts, pa.string())))
        want = [[*e.ids, 0] for e in encoder.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert len(encoder.keys) < 400
