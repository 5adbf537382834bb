"""Every registered scene query against the SQL that defines it, on the smallest tables."""

import duckdb
import pytest

from placeloom.operators import align, tracks
from placeloom.plans import registry, scene

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    names = sorted(df.columns)
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == names
    place = [list(rel.columns).index(c) for c in names]
    want = sorted(str([norm(r[k]) for k in place]) for r in rel.fetchall())
    got = sorted(str([norm(r[c]) for c in names]) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs_where_sql_cannot_say(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_routes_of_all_sessions(spark):
    """sf0.01 has more sessions than the smallest tables."""
    d = "/root/testdata/sf0.01"
    poses = scene.poses(spark, d).orderBy("session", "seq").toPandas()
    want = {}
    for k, g in poses.groupby("session"):
        want |= dict(zip([(k, s) for s in g.seq], tracks.smooth(g[["x", "y", "z"]].to_numpy(float))))
    got = {(r.session, r.seq): (r.x, r.y) for r in registry.queries()["w4_smooth"](spark, d).collect()}
    assert got.keys() == want.keys() and all(abs(got[k][c] - want[k][c]) < 1e-3 for k in got for c in (0, 1))
    ids = registry.queries()["g13_session_route"](spark, d).select("id").collect()
    assert {r.id.split("_")[0] for r in ids} == {str(s) for s in poses.session.unique()}


def test_areas_and_scales_see_every_object(spark, sf_dir, monkeypatch):
    seen, scale = [], align.median_scale
    monkeypatch.setattr(align, "median_scale", lambda a, b, key="id": (seen.append(a.count()), scale(a, b, key))[1])
    for name in ("x3_sim3_from_poses", "a24_sim3_scale"):
        registry.queries()[name](spark, sf_dir).collect()
    o = scene.objects(spark, sf_dir)
    assert seen == [o.count()] * 2
    # label L2 stands for mirrors, which are gates and no members
    n = registry.queries()["e6_areas"](spark, sf_dir).agg({"n": "sum"}).first()[0]
    assert n == o.where("label <> 'L2'").count()


def test_whole_texts_are_escaped(spark, sf_dir):
    texts = {r.item_id: r.text for r in scene.read(spark, sf_dir, "benchmark").collect()}
    got = {r.item_id: r.html for r in registry.queries()["x19_html_escape"](spark, sf_dir).collect()}
    assert got == {k: v.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") for k, v in texts.items()}
    assert max(map(len, texts.values())) > 60
