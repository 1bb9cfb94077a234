"""Verbs over small record streams: absent and empty fields, order, ties, groups of one."""

import pytest

import streamweave.operators  # noqa: F401
from streamweave.operators import VERBS
from streamweave.operators.joins import concat
from streamweave.operators.reshape import seqgen
from streamweave.plans.chain import chain, split_chain
from streamweave.plans.stream import Stream, col
from streamweave.sources.writers import text_of

ROWS = [
    ("pan", "pan", 1, "0.35", "0.73"), ("eks", "pan", 2, "0.76", "0.52"), ("wye", "wye", 3, "0.20", "0.34"), ("eks", "wye", 4, "0.38", "0.13"), ("wye", "pan", 5, "0.57", "0.86"),
    ("zee", "pan", 6, "0.53", ""), ("eks", "zee", 7, None, "0.19"),
]


@pytest.fixture(scope="module")
def s(spark):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(ROWS)], "k int, a string, b string, i int, x string, y string").repartition(3)
    return Stream.of(df, "k").select(["a", "b", "i", "x", "y"])


def run(s, links, **streams):
    return text_of(chain(s, links, **streams), "dkvp").splitlines()


CASES = {
    "cat -n -g a then cut -f n,a": ["n=1,a=pan", "n=1,a=eks", "n=1,a=wye", "n=2,a=eks", "n=2,a=wye", "n=1,a=zee", "n=3,a=eks"],
    "head -n 1 -g a then cut -f a,i": ["a=pan,i=1", "a=eks,i=2", "a=wye,i=3", "a=zee,i=6"],
    "head -n -5 then cut -f i": ["i=1", "i=2"],
    "tail -n 1 -g a then cut -f a,i": ["a=pan,i=1", "a=eks,i=7", "a=wye,i=5", "a=zee,i=6"],
    "tail -n 2 then cut -f i": ["i=6", "i=7"],
    "tail -n +6 then cut -f i": ["i=6", "i=7"],
    "cut -o -f y,a then head -n 1": ["y=0.73,a=pan"],
    "cut -x -r -f ^[abx]$ then head -n 1": ["i=1,y=0.73"],
    "cut -r -f '\"A\"i' then head -n 1": ["a=pan"],
    "sort -nr x then cut -f x,i": ["i=2,x=0.76", "i=5,x=0.57", "i=6,x=0.53", "i=4,x=0.38", "i=1,x=0.35", "i=3,x=0.20", "i=7"],
    "sort -f a -nr i then cut -f a,i then head -n 3": ["a=eks,i=7", "a=eks,i=4", "a=eks,i=2"],
    "sort -c b -nr i then tac then cut -f i then head -n 2": ["i=7", "i=3"],
    "tac then head -n 2 then cut -f i": ["i=7", "i=6"],
    "tac then tac then head -n 1 then cut -f i": ["i=1"],
    "group-by a then cut -f i": ["i=1", "i=2", "i=4", "i=7", "i=3", "i=5", "i=6"],
    "count": ["count=7"],
    "count -g a": ["a=pan,count=1", "a=eks,count=3", "a=wye,count=2", "a=zee,count=1"],
    "count -d -g a": ["a=pan", "a=eks", "a=wye", "a=zee"],
    "count -n -g a": ["count=4"],
    "count -g x then count": ["count=6"],
    "count-similar -g a then cut -f i,count then head -n 3": ["i=1,count=1", "i=2,count=3", "i=4,count=3"],
    "uniq -g a -c then head -n 2": ["a=pan,count=1", "a=eks,count=3"],
    "uniq -d -g a then cut -f a,i": ["a=eks,i=2", "a=wye,i=3"],
    "uniq -u -g a then cut -f a,i": ["a=pan,i=1", "a=zee,i=6"],
    "cut -f a then uniq -a -c": ["count=1,a=pan", "count=3,a=eks", "count=2,a=wye", "count=1,a=zee"],
    "most-frequent -f a -n 2": ["a=eks,count=3", "a=wye,count=2"],
    "least-frequent -f a -n 1 -b": ["a=pan"],
    "stats1 -a count,max,mode,antimode,null_count -f y -g a": [
        "a=pan,y_count=1,y_max=0.73,y_mode=0.73,y_antimode=0.73,y_null_count=0", "a=eks,y_count=3,y_max=0.52,y_mode=0.52,y_antimode=0.52,y_null_count=0",
        "a=wye,y_count=2,y_max=0.86,y_mode=0.34,y_antimode=0.34,y_null_count=0", "a=zee,y_count=0,y_null_count=1",
    ],
    "stats1 -a p0,p25,p50,p75,p100,first,last -f i": ["i_p0=1,i_p25=2,i_p50=4,i_p75=6,i_p100=7,i_first=1,i_last=7"],
    "head -n 4 then stats1 -a p25,p50,p75 -f i": ["i_p25=2,i_p50=3,i_p75=4"],
    "head -n 4 then stats1 -i -a p25,p50 -f i": ["i_p25=1.75,i_p50=2.5"],
    "head -n 1 then stats1 -a var,meaneb,mad -f i": ["i_mad=0"],
    "merge-fields -a sum,count -f x,y -o o then cut -f i,o_sum,o_count then tail -n 2": ["i=6,o_sum=0.53,o_count=1", "i=7,o_sum=0.19,o_count=1"],
    "step -a delta,shift,shift_lead,rsum,counter,ratio -f i -g a then cut -x -f b,x,y then tail -n 1": ["a=eks,i=7,i_delta=3,i_shift=4,i_rsum=13,i_counter=3,i_ratio=1.75"],
    "step -a ewma -d 0.5 -o h -f i then cut -f i_ewma_h then head -n 3": ["i_ewma_h=1", "i_ewma_h=1.5", "i_ewma_h=2.25"],
    "rank -f i -g a then cut -f i_rank": ["i_rank=1", "i_rank=1", "i_rank=1", "i_rank=2", "i_rank=2", "i_rank=1", "i_rank=3"],
    "fraction -f i -c then cut -f i_cumulative_fraction then tail -n 1": ["i_cumulative_fraction=1"],
    "fill-down -f x then tail -n 1 then cut -f x": ["x=0.53"],
    "fill-down -f y then cut -f y then tail -n 2": ["y=0.86", "y=0.19"],
    "fill-down -a -f y then cut -f y then tail -n 2": ["y=", "y=0.19"],
    "fill-empty -v X then cut -f x,y then tail -n 2": ["x=0.53,y=X", "y=0.19"],
    "unsparsify --fill-with X then cut -f x,y then tail -n 2": ["x=0.53,y=", "x=X,y=0.19"],
    "sparsify then cut -f i,y then tail -n 2": ["i=6", "i=7,y=0.19"],
    "top -n 2 -f x -g a": ["a=eks,top_idx=1,x_top=0.76", "a=eks,top_idx=2,x_top=0.38", "a=pan,top_idx=1,x_top=0.35", "a=pan,top_idx=2", "a=wye,top_idx=1,x_top=0.57", "a=wye,top_idx=2,x_top=0.2", "a=zee,top_idx=1,x_top=0.53", "a=zee,top_idx=2"],
    "top -n 1 -f i -a --min then cut -f i": ["i=1"],
    "reshape -i x,y -o k,v then reshape -s k,v then tail -n 1": ["a=eks,b=zee,i=7,y=0.19"],
    "cut -f a,b then nest --ivar ; -f b": ["a=pan,b=pan", "a=eks,b=pan;wye;zee", "a=wye,b=wye;pan", "a=zee,b=pan"],
    "cut -f a,b then nest --ivar ; -f b then nest --evar ; -f b then tail -n 3": ["a=wye,b=wye", "a=wye,b=pan", "a=zee,b=pan"],
    "having-fields --at-least x then count": ["count=6"],
    "grep -i A=E then count": ["count=3"],
    "grep -v pan then count": ["count=3"],
    "decimate -n 3 then cut -f i": ["i=3", "i=6"],
    "decimate -n 3 -b then cut -f i": ["i=1", "i=4", "i=7"],
    "head -n 2 then repeat -f i then cut -f i": ["i=1", "i=2", "i=2"],
    "label p,q then head -n 1 then cut -f p,q,i": ["p=pan,q=pan,i=1"],
    "rename a,b then head -n 1": ["b=pan,i=1,x=0.35,y=0.73"],
    "rename -r '^(.)$,f_\\1' then head -n 1": ["f_a=pan,f_b=pan,f_i=1,f_x=0.35,f_y=0.73"],
    "reorder -f x,i then head -n 1": ["i=1,x=0.35,a=pan,b=pan,y=0.73"],
    "reorder -e -f a then head -n 1": ["b=pan,i=1,x=0.35,y=0.73,a=pan"],
    "sub -f a e X then cut -f a then head -n 3": ["a=pan", "a=Xks", "a=wyX"],
    "gsub -f a,b [ae] Y then cut -f a then head -n 2": ["a=pYn", "a=Yks"],
    "case -u -v -f a then cut -f a then head -n 1": ["a=PAN"],
    "sec2gmt -1 i then cut -f i then head -n 1": ["i=1970-01-01T00:00:01.0Z"],
    "format-values -n -f %.2f then cut -f a,i,x then head -n 1": ["a=pan,i=1.00,x=0.35"],
    "template -f z,a then head -n 1": ["z=,a=pan"],
    "histogram -f x --lo 0 --hi 1 --nbins 2": ["bin_lo=0,bin_hi=0.5,x_count=3", "bin_lo=0.5,bin_hi=1,x_count=3"],
    "nothing": [],
    "altkv then head -n 1": ['kv={"pan":"pan","1":"0.35","3":"0.73"}'],
    "sparkline -f i": ["field=i,n=7,lo=1,hi=7,sparkline=▁▂▃▅▆▇█"],
    "seqgen -f i --start 10 --stop 1 --step -4": ["i=10", "i=6", "i=2"],
}


@pytest.mark.parametrize("links", list(CASES))
def test_case(s, links):
    assert run(s, links) == CASES[links]


def test_every_verb_of_the_inventory_is_there():
    names = """altkv bar bootstrap bootstrap-ci case cat check clean-whitespace count count-distinct count-similar cut decimate describe fill-down fill-empty filter flatten format-values fraction gap grep
    group-by group-like gsub having-fields head histogram join json-parse json-stringify label latin1-to-utf8 least-frequent merge-fields most-frequent nest nothing put rank regularize remove-empty-columns rename reorder
    repeat reshape sample sec2gmt sec2gmtdate seqgen shuffle skip-trivial-records sort sort-within-records sparkline sparsify split ssub stats1 stats2 step sub summary surv tac tail tee template top unflatten uniq unspace
    unsparsify utf8-to-latin1""".split()
    assert len(names) == 74 and set(names) == set(VERBS)


def _pair(spark):
    left = spark.createDataFrame([(0, 1, "l1"), (1, 1, "l1b"), (2, 2, "l2"), (3, 9, "l9")], "k int, id int, v string")
    right = spark.createDataFrame([(0, 1, "r1"), (1, 3, "r3"), (2, 2, "r2"), (3, None, "r0")], "k int, id int, v string")
    return (Stream.of(x, "k").select(["id", "v"]) for x in (left, right))


def test_joins(spark):
    left, right = _pair(spark)
    assert run(right, "join -j id --lp L_ --rp R_ -f X", X=left) == ["id=1,L_v=l1,R_v=r1", "id=1,L_v=l1b,R_v=r1", "id=2,L_v=l2,R_v=r2"]
    assert run(right, "join -j id -f X", X=left) == ["id=1,v=r1", "id=1,v=r1", "id=2,v=r2"]
    assert run(right, "join --np --ul -j id -f X", X=left) == ["id=9,v=l9"]
    assert run(right, "join --np --ur -j id -f X", X=left) == ["id=3,v=r3", "v=r0"]
    assert run(right, "join --ul --ur -j id -f X then cut -f id", X=left) == ["id=1", "id=1", "id=3", "id=2", "", "id=9"]
    assert run(right, "join -s -j id --lk v --lp L_ --rp R_ -f X then count", X=left) == ["count=3"]
    with pytest.raises(ValueError):
        run(right, "join --np -j id -f X", X=left)


def test_empty_keys_of_joins(spark):
    a = Stream.of(spark.createDataFrame([(0, "", "p")], "k int, id string, v string"), "k").select(["id", "v"])
    b = Stream.of(spark.createDataFrame([(0, "", "q")], "k int, id string, w string"), "k").select(["id", "w"])
    assert run(b, "join -j id -f A", A=a) == ["id=,v=p,w=q"]
    assert run(b, "join --ignore-empty -j id -f A", A=a) == []


def test_concat_is_in_order(s):
    both = concat(chain(s, "head -n 1 then cut -f a,i"), chain(s, "tail -n 1 then cut -f a,x"))
    assert text_of(both, "dkvp").splitlines() == ["a=pan,i=1", "a=eks"]


def test_natural_order(spark):
    df = spark.createDataFrame([(0, "a10"), (1, "a9"), (2, "a1"), (3, "b02"), (4, "b2")], "k int, v string")
    s = Stream.of(df, "k").select(["v"])
    assert run(s, "sort -t v") == ["v=a1", "v=a9", "v=a10", "v=b02", "v=b2"]
    assert run(s, "sort -tr v then head -n 1") == ["v=b02"]
    assert run(s, "sort -f v then head -n 2") == ["v=a1", "v=a10"]


def test_numbers_in_text(spark):
    from streamweave.plans.stream import text_double, text_long

    cases = {
        "1": (1, 1.0), "-3": (-3, -3.0), "+4": (4, 4.0), "0xff": (255, 255.0), "-0x10": (-16, -16.0), "0b101": (5, 5.0), "0o17": (15, 15.0), "007": (None, None), "1.5": (None, 1.5), "1e3": (None, 1000.0), ".5": (None, 0.5),
        "5.": (None, 5.0), "1d": (None, None), " 3 ": (None, None), "": (None, None), "abc": (None, None), "99999999999999999999": (None, None), "Inf": (None, float("inf")), "-infinity": (None, float("-inf")), "0": (0, 0.0), "-0": (0, 0.0),
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    for r in df.select("v", text_long(col("v")).alias("l"), text_double(col("v")).alias("d")).collect():
        assert (r.l, r.d) == cases[r.v], r.v


def test_random_verbs(spark):
    s = Stream.of(spark.range(100).withColumnRenamed("id", "v"), "v")
    assert chain(s, "sample -k 7 --seed 1").df.count() == 7
    assert chain(s, "bootstrap --seed 1").df.count() == 100
    assert sorted(r.v for r in chain(s, "shuffle --seed 1").rows().collect()) == list(range(100))
    lo_hi = chain(s, "bootstrap-ci -a mean -f v -n 200").rows().first()
    assert lo_hi["v_mean_lo"] < lo_hi["v_mean"] == 49.5 < lo_hi["v_mean_hi"]


def test_summaries(s):
    got = {r["field_name"]: r for r in chain(s, "summary --all").rows().collect()}
    assert got["a"]["mode"] == "eks" and got["a"]["distinct_count"] == "4" and got["a"]["field_type"] == "string" and got["i"]["median"] == "4" and got["y"]["null_count"] == "1" and got["y"]["field_type"] == "empty-float"
    d = {r["field_name"]: r for r in chain(s, "describe -n 4").rows().collect()}
    assert d["a"]["values"] == ["pan", "eks", "wye", "zee"] and d["i"]["values"] is None and d["y"]["types"] == {"float": 6, "empty": 1}


def test_stats2(spark):
    s = Stream.of(spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(10)], "x double, y double"), "x")
    r = chain(s, "stats2 -a linreg-ols,r2,corr,cov,linreg-pca -f x,y").rows().first()
    assert abs(r["x_y_ols_m"] - 2) < 1e-9 and abs(r["x_y_ols_b"] - 1) < 1e-9 and abs(r["x_y_r2"] - 1) < 1e-9 and abs(r["x_y_pca_m"] - 2) < 1e-9 and abs(r["x_y_corr"] - 1) < 1e-9
    fit = chain(s, "stats2 -a linreg-ols --fit -f x,y").rows().collect()
    assert all(abs(q["x_y_ols_fit"] - q["y"]) < 1e-9 for q in fit)
    s = Stream.of(spark.createDataFrame([(float(x), 1.0 if x + (x % 3) > 10 else 0.0) for x in range(20)], "x double, y double"), "x")
    r = chain(s, "stats2 -a logireg -f x,y").rows().first()
    assert r["x_y_logistic_m"] > 0 > r["x_y_logistic_b"]


def test_sums_of_integers_stay_integers(spark):
    s = Stream.of(spark.createDataFrame([(1, 2, 3)], "a int, b int, c int"), "a")
    r = chain(s, "merge-fields -a sum,max,mean -f a,b,c -o o").rows()
    assert dict(r.dtypes)["o_sum"] == "bigint" and r.first()["o_sum"] == 6 and r.first()["o_max"] == 3 and r.first()["o_mean"] == 2.0


def test_flatten_and_unflatten(spark):
    df = spark.sql("SELECT 1 AS k, named_struct('x', 5, 'y', array(7, 8)) AS m, map('p', 1, 'q', 2) AS h")
    s = Stream.of(df, "k")
    assert run(s, "flatten") == ["k=1,m.x=5,m.y.1=7,m.y.2=8,h.p=1,h.q=2"]
    assert run(s, "flatten then unflatten then json-stringify -f m") == ['k=1,m={"x":5,"y":[7,8]},h={"p":1,"q":2}']


def test_chains_that_cannot_be():
    with pytest.raises(ValueError):
        split_chain("cat then then tac")


def test_unknown_verbs_and_options(s):
    for bad in ("frob", "head -z 3", "cat extra"):
        with pytest.raises(ValueError):
            chain(s, bad)


def test_seqgen_steps(spark):
    assert [r.i for r in seqgen(spark, "i", 1, 2, 0.25).sorted().collect()] == [1.0, 1.25, 1.5, 1.75, 2.0]
    with pytest.raises(ValueError):
        seqgen(spark, "i", 1, 2, 0)
