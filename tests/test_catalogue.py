"""Every query over the given tables against its SQL, and against brute force where SQL has none."""

import hashlib
import itertools
import random
import re
from datetime import date, timedelta
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from tessera import catalogue
from tessera.functions import html
from tessera.functions.text import gram_list
from tessera.operators import routes
from tessera.plans import event_queries, market_queries
from tessera.plans import views as v

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(str(tuple(round(x, 5) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_agrees_with_sql(spark, data, con, name):
    got = catalogue.QUERIES[name](spark, data)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.SQL[name]})").fetchall()
    assert plain(got.select(*columns).collect()) == plain(want)


def test_factor_queries_do_not_depend_on_splits(spark, data, tmp_path):
    """Suppliers' months over many files: sums of doubles in the order of the rows, as the SQL adds them up in one thread."""
    c = duckdb.connect(config={"threads": 1})
    c.execute(f"CREATE TABLE lineitem AS SELECT * REPLACE (l_orderkey % 40 AS l_suppkey) FROM '{data}/lineitem.parquet'")
    (tmp_path / "lineitem.parquet").mkdir()
    for i in range(12):
        c.execute(f"COPY (SELECT * FROM lineitem WHERE rowid >= {i * 500} AND rowid < {(i + 1) * 500}) TO '{tmp_path}/lineitem.parquet/part-{i:03}.parquet'")
    assert c.execute("SELECT count(*) FROM lineitem").fetchone() == c.execute(f"SELECT count(*) FROM '{tmp_path}/lineitem.parquet/*.parquet'").fetchone()
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # a task for each file
    try:
        for name in ("dense_factors", "quintile_returns", "ic_summary", "rank_ic"):
            got = catalogue.QUERIES[name](spark, str(tmp_path))
            columns = sorted(got.columns)
            assert plain(got.select(*columns).collect()) == plain(c.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.SQL[name]})").fetchall()), name
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


#: Queries that SQL can't express, or not in useful time; each has a test below.
BRUTE = {"ngram_near_dup", "greedy_dedup", "html_text", "hashed_embedding", "stable_rulebook", "ridge_forecast", "bootstrap_ci", "route_comparison"} | {"period_models", "walk_forward_forecasts", "marginal_text_effects", "single_text_model", "study_signals"}  # in test_nowcast and test_study


def test_every_query_is_held_against_something():
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == BRUTE


def test_near_pairs_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    sets = {}
    for d, t in docs:
        day = date(1995, 1, 2) + timedelta(days=d % 2499)
        sets[d] = ((day.year, max(day.month, 2)), set(gram_list(t, (5,))) or {x for x in ["".join(gram_list(t, (1,)))] if x})
    want = {(a, b) for a in sets for b in sets if a < b and sets[a][0] == sets[b][0] and sets[a][1] and sets[b][1] and len(sets[a][1] & sets[b][1]) >= 0.88 * min(len(sets[a][1]), len(sets[b][1]))}
    assert {(r["earlier"], r["later"]) for r in catalogue.QUERIES["ngram_near_dup"](spark, data).collect()} == want


def similar(a, b):
    return bool(a and b) and len(a & b) >= 0.88 * min(len(a), len(b))


def test_ordered_dedup_against_brute_force(spark, data):
    """Documents in order: one stays unless it shares a fingerprint, or is similar within its period, with one that stayed."""
    rows = []
    for d, t in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect():
        day = date(1995, 1, 2) + timedelta(days=d % 2499)
        plain_text = re.sub(r"[^0-9a-zA-Z\u4e00-\u9fff]+", "", t or "").lower()
        rows.append((day, d, plain_text, (day.year, max(day.month, 2)), set(gram_list(t, (5,))) or ({plain_text} if plain_text else set())))
    kept = []
    for row in sorted(rows, key=lambda r: r[:2]):
        if not any(row[2] == k[2] or (row[3] == k[3] and similar(row[4], k[4])) for k in kept):
            kept.append(row)
    got = catalogue.QUERIES["greedy_dedup"](spark, data).collect()
    assert sorted((r["publish_time"], r["doc_id"]) for r in got) == sorted((str(k[0]), k[1]) for k in kept) and len(kept) < len(rows)


class Shown(HTMLParser):
    """What the standard parser reports outside hidden elements."""

    def __init__(self):
        super().__init__()
        self.out, self.depth = "", 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in html.HIDDEN
        self.out += "\n" * (tag in html.BLOCKS)

    def handle_endtag(self, tag):
        self.depth -= self.depth > 0 and tag in html.HIDDEN
        self.out += "\n" * (tag in html.BLOCKS)

    def handle_data(self, data):
        self.out += "" if self.depth else data


def test_visible_text_against_the_standard_parser(spark, data):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    want = {}
    for i, page in pages.items():
        parser = Shown()
        parser.feed(page)
        parser.close()
        lines = [re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in parser.out.split("\n")]
        text = "\n".join(x for x in lines if x)
        want[i] = (len(text), hashlib.sha256(text.encode()).hexdigest())
    assert {r["page_id"]: (r["characters"], r["digest"]) for r in catalogue.QUERIES["html_text"](spark, data).collect()} == want
    assert html.visible("a<br>b &amp; c<script>x<p>y</script>d<!-- <p> -->e<nav>n<nav>m</nav>o</nav>f &lt;p&gt;") == "a\nb & cdef <p>" and html.visible(None) is None and html.visible("<nav>never closed") == ""


def test_hashed_vectors_against_plain_sums(spark, data):
    want = {}
    for r in spark.read.parquet(f"{data}/benchmark.parquet").collect():
        plain_text, sums = re.sub(r"\s+", "", r["text"].lower()), [0] * 512
        for term in [plain_text[i : i + n] for n in (2, 3, 4) for i in range(len(plain_text) - n + 1)] + re.findall(r"[a-z0-9_]+", r["text"].lower()):
            h = int(hashlib.blake2b(term.encode(), digest_size=8).hexdigest(), 16)
            sums[h % 512] += 1 if h >= 1 << 63 else -1
        length = sum(x * x for x in sums) ** 0.5
        want[r["item_id"]] = [round(x / length * 1_000_000) if length else 0 for x in sums]
    got = {r["item_id"]: r for r in catalogue.QUERIES["hashed_embedding"](spark, data).collect()}
    assert {i: (r["dims"], r["used"], r["digest"]) for i, r in got.items()} == {i: (512, sum(x != 0 for x in w), hashlib.sha256(",".join(map(str, w)).encode()).hexdigest()) for i, w in want.items()}


def test_stable_rules_against_brute_force(spark, data):
    records = [(r["doc_id"], r["publish_time"], set(r["names"]), r["direction_label"]) for r in v.records(spark, data).collect()]
    names = sorted({n for r in records for n in r[2]})
    combos = [c for k in (1, 2) for c in itertools.combinations(names, k)]
    want = []
    for target in ("bullish", "bearish"):
        positive = [r for r in records if r[3] == target]
        negative = [r for r in records if r[3] != target]
        book = []
        for c in combos:
            hit = [r for r in records if set(c) <= r[2]]
            score = sum(r[3] == target for r in hit) / len(positive) - sum(r[3] != target for r in hit) / len(negative)
            if score > 0 and len({r[0] for r in hit}) >= 5 and len({r[1] for r in hit}) >= 3:
                book.append((-score, len(c), -len(hit), c, frozenset(r[0] for r in hit)))
        seen = set()
        for _, _, _, c, cover in sorted(book, key=lambda x: x[:4])[:5]:
            steady = True
            for low, high in ((date(1995, 1, 1), date(1995, 6, 30)), (date(1995, 7, 1), date(1995, 12, 31))):
                of = lambda rows: [set(c) <= r[2] for r in rows if low <= r[1] <= high]  # noqa: B023, E731
                p, n = of(positive), of(negative)
                steady &= sum(p) + sum(n) >= 1 and (sum(p) / len(p) if p else 0) - (sum(n) / len(n) if n else 0) > 0
            if steady and cover not in seen:
                seen.add(cover)
                want.append((target, " AND ".join(c), len(cover)))
    assert sorted((r["target_label"], r["conditions"], r["covered"]) for r in catalogue.QUERIES["stable_rulebook"](spark, data).collect()) == sorted(want)


def test_linear_models_against_numpy(spark, data):
    lines = spark.read.parquet(f"{data}/lineitem.parquet").selectExpr("l_quantity", "l_discount", "l_tax", "l_extendedprice / 1000 AS y", "month(l_shipdate) AS m").toPandas().astype(float)
    x, y = lines[["l_quantity", "l_discount", "l_tax"]].to_numpy(), lines["y"].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    ridge = np.linalg.solve(z.T @ z + 10.0 * np.eye(3), z.T @ (y - y.mean()))
    net, n = np.zeros(3), len(y)
    for _ in range(2000):
        for j in range(3):
            rho = z[:, j] @ (y - y.mean() - z @ net + z[:, j] * net[j]) / n
            net[j] = np.sign(rho) * max(abs(rho) - 0.05, 0) / (z[:, j] @ z[:, j] / n + 0.05)
    lines["ridge"], lines["net"] = np.clip(z, -3, 3) @ ridge + y.mean(), z @ net + y.mean()
    want = lines.groupby("m")[["ridge", "net", "y"]].mean()
    got = catalogue.QUERIES["ridge_forecast"](spark, data).collect()
    assert len(got) == len(want) and all((r["ridge"], r["net"], r["actual"]) == pytest.approx(tuple(want.loc[r["month"]]), abs=2e-3) for r in got)


def test_bootstrap_against_plain_draws(spark, data):
    rows = market_queries._overlay_rows(spark, data, 0.35, 0.2).select("trade_date", "strategy", "net_return").toPandas().pivot(index="trade_date", columns="strategy", values="net_return").dropna().sort_index()
    d = (rows["enhanced"] - rows["baseline"]).tolist()
    draw, size, estimates = random.Random(20260815), 63, []
    for _ in range(2000):
        sample = []
        for _ in range(-(-len(d) // size)):
            start = draw.choice(range(len(d) - size + 1))
            sample += d[start : start + size]
        estimates.append(sum(sample[: len(d)]) / len(d) * 252)
    estimates.sort()
    got = catalogue.QUERIES["bootstrap_ci"](spark, data).first()
    assert (got["observations"], got["samples"]) == (len(d), 2000) and got["annualized_difference"] == pytest.approx(sum(d) / len(d) * 252)
    assert (got["ci_lower_95"], got["ci_upper_95"]) == pytest.approx((estimates[50], estimates[1950]))


def test_route_comparison_against_numpy(spark, data):
    rows = event_queries._splits(spark, data).orderBy("period_end").toPandas()
    train, check = rows[rows.split == "train"], rows[rows.split == "validation"]
    x, y, columns = train[routes.OWN_PAST].to_numpy(float), train["target"].to_numpy(float), routes.OWN_PAST
    scale = np.where(x.std(0) > 1e-12, x.std(0), 1.0)
    z = (x - x.mean(0)) / scale
    beta = np.linalg.lstsq(z.T @ z + 10.0 * np.eye(len(columns)), z.T @ (y - y.mean()), rcond=None)[0]  # fewer than 24 rows: the plain penalty
    errors = (check[columns].to_numpy(float) - x.mean(0)) / scale @ beta + y.mean() - check["target"].to_numpy(float)
    got = catalogue.QUERIES["route_comparison"](spark, data).collect()
    assert len(train) < 24 and {r["route"] for r in got} == {"base", "rules"}
    assert all((r["n"], r["base_mae"], r["base_rmse"]) == (len(check), pytest.approx(np.abs(errors).mean(), abs=1e-4), pytest.approx(np.sqrt((errors**2).mean()), abs=1e-4)) for r in got)
