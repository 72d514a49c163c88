"""The registered queries in DuckDB SQL, over the supplied tables as views."""

from __future__ import annotations

from statistics import NormalDist

from ..functions.draws import poisson_steps
from ..params import EDUCATION_LABELS, Params
from ..sources.survey_view import AGE_BAND_LABELS
from .queries import GIVEN_CENTILE_COEFFICIENTS

P = Params()
Z975 = NormalDist().inv_cdf(0.975)
WORD = float(16**13)


def _hash(stream: str, *keys: str) -> str:
    return f"md5(concat_ws('|', '{stream}', {', '.join(keys)}))"


def _word(hexed: str, start: int = 1, digits: int = 13) -> str:
    return f"((('0x' || substr({hexed}, {start}, {digits}))::BIGINT + 0.5e0) / {float(16**digits)!r})"


def uniform(stream: str, *keys: str) -> str:
    return _word(_hash(stream, *keys))


def normal(stream: str, *keys: str) -> str:
    h = _hash(stream, *keys)
    return f"(sqrt(-2e0 * ln({_word(h)})) * cos(2e0 * pi() * {_word(h, 14)}))"


def poisson(u: str) -> str:
    return "(" + " + ".join(f"({u} >= {s!r})::INT" for s in poisson_steps()) + ")"


def values(rows) -> str:
    def text(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return "VALUES " + ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in rows)


def band(x: str, width) -> str:
    return f"({x} - ((({x}) % {width}) + {width}) % {width})"


_BANDS = [(k, *map(int, v.split("-"))) for k, v in AGE_BAND_LABELS.items()]
_EDU = list(enumerate(EDUCATION_LABELS, 1))

RAW = f"""base AS (
  SELECT o_orderkey AS row_id, (1991 + o_orderkey % 29)::INT AS yr, (1 + o_custkey % 2)::INT AS sexcode,
         (15 + (o_custkey * 31 + o_orderkey * 17) % 56)::INT AS age0, o_totalprice, c_acctbal, c_nationkey, o_orderpriority
  FROM orders JOIN customer ON o_custkey = c_custkey),
base1 AS (
  SELECT *, CASE WHEN yr = 1992 THEN 1991 ELSE yr END AS wave, CASE WHEN row_id % 97 = 0 THEN -1 ELSE age0 END AS age1 FROM base),
raw AS (
  SELECT row_id, wave, yr, sexcode, age1,
    CASE WHEN row_id % 53 = 0 THEN 90 ELSE age1 END AS age90,
    CASE WHEN row_id % 53 = 0 THEN 22 WHEN age1 < 0 THEN NULL WHEN age1 <= 15 THEN 6 WHEN age1 <= 19 THEN 7
         ELSE least(8 + floor((age1 - 20) / 5)::INT, 22) END AS code,
    CASE WHEN row_id % 211 = 0 THEN 95e0 ELSE
      13e0 + 10e0 * (o_totalprice / 500000e0) + 10e0 * ((c_acctbal + 1000e0) / 11000e0) + 0.06e0 * age0
      + 6e0 * ((row_id * 7919) % 1000 / 1000e0) END AS rawbmi,
    row_id % 8 <> 0 AS ok, 1 + c_nationkey % 5 AS eth, substr(o_orderpriority, 1, 1)::INT AS samptype,
    (row_id % 10 - 1)::INT AS qual, 0.5e0 + (row_id % 100) / 100e0 AS rawwt
  FROM base1)"""

CLEAN = f"""WITH {RAW},
bands(bcode, lo, hi) AS ({values(_BANDS)}),
edus(qcode, edu) AS ({values(_EDU)}),
kept AS (
  SELECT * FROM raw WHERE
    CASE WHEN wave BETWEEN 2008 AND 2010 THEN eth BETWEEN 1 AND 3 WHEN wave BETWEEN 2011 AND 2013 THEN eth BETWEEN 1 AND 4 ELSE eth = 1 END
    AND CASE WHEN wave IN (2000, 2002) THEN samptype = 2 WHEN wave IN (2005, 2007, 2008, 2009, 2010, 2015) THEN samptype = 1
             WHEN wave = 2006 THEN samptype BETWEEN 1 AND 2 ELSE TRUE END),
aged AS (
  SELECT kept.*, CASE WHEN wave = 1991 THEN yr ELSE wave END AS year,
    CASE WHEN wave = 2014 THEN nullif(age90, 90)
         WHEN wave >= 2015 THEN lo + floor({uniform('band_age', "'1'", 'row_id')} * (hi - lo + 1))::INT ELSE age1 END AS age2,
    CASE WHEN wave NOT IN (1995, 1996) THEN edus.edu END AS edu
  FROM kept LEFT JOIN bands ON code = bcode LEFT JOIN edus ON qual = qcode),
clean AS (
  SELECT row_id, year::INT AS year, CASE sexcode WHEN 1 THEN 'Male' ELSE 'Female' END AS sex,
    (CASE WHEN age2 > 0 THEN age2 END)::INT AS age,
    CASE WHEN ok AND rawbmi BETWEEN 13 AND 70 THEN rawbmi END AS bmi, edu,
    CASE WHEN wave >= 2003 THEN rawwt ELSE 1e0 END AS wt_int,
    (CASE WHEN age2 > 0 THEN year - age2 END)::INT AS birth
  FROM aged)"""

ADULT = CLEAN + """, adult AS (SELECT * FROM clean WHERE age BETWEEN 20 AND 64)"""
COHORT = ADULT + f""", c0 AS (SELECT *, {band('birth', 10)} AS cohort FROM adult),
cohorts AS (
  SELECT row_id, year, sex, age, bmi, wt_int, birth, cohort::INT AS cohort FROM c0
  WHERE cohort IN (SELECT cohort FROM c0 GROUP BY cohort HAVING max(age) >= 24 AND min(age) <= 70)
    AND cohort > 1920 AND bmi IS NOT NULL),
st AS (SELECT *, unnest([lower(sex), 'all']) AS stratum FROM cohorts),
stw AS (SELECT *, wt_int * count(*) OVER w / sum(wt_int) OVER w AS w FROM st WINDOW w AS (PARTITION BY cohort, stratum, year))"""
AGEBAND = ADULT + f""", ab AS (
  SELECT *, {band('age', 5)}::INT AS cohort FROM adult WHERE bmi IS NOT NULL),
st AS (SELECT *, unnest([lower(sex), 'all']) AS stratum FROM ab)"""
MISSING = ADULT + """, miss AS (
  SELECT *, (bmi IS NULL)::INT AS miss_bmi FROM adult
  WHERE birth IN (SELECT birth FROM adult GROUP BY birth HAVING max(age) >= 24 AND min(age) <= 60))"""
FRAME = MISSING + """, frame AS (
  SELECT row_id, bmi, (age - min(age) OVER ()) / (max(age) OVER () - min(age) OVER ())::DOUBLE AS age_s, age, birth, wt_int,
         bmi IS NOT NULL AS obs FROM miss)"""


def _cube(x: str) -> str:
    return f"power(greatest({x}, 0e0), 3)"


def _spline(x: str, terms: int, name: str) -> str:
    """CTEs of distinct values per stratum with their natural cubic basis."""
    probs = ", ".join(f"quantile_cont({x}::DOUBLE, {i / terms!r})" for i in range(1, terms))
    cuts = ", ".join(f"coalesce((k[{i + 1}] - lo) / nullif(hi - lo, 0), 0) AS k{i}" for i in range(terms - 1))
    last = f"k{terms - 2}"

    def d(at: str) -> str:
        return f"coalesce(({_cube(f's - {at}')} - {_cube('s - 1e0')}) / nullif(1e0 - {at}, 0), 0)"

    cols = [f"s AS {name}1"]
    first = d("0e0")
    inner = [first] + [d(f"k{i}") for i in range(terms - 2)]
    cols += [f"{e} - {d(last)} AS {name}{i + 2}" for i, e in enumerate(inner)]
    return f""", dv AS (SELECT DISTINCT cohort, stratum, {x} FROM st),
kn AS (SELECT cohort, stratum, min({x})::DOUBLE AS lo, max({x})::DOUBLE AS hi, [{probs}] AS k FROM dv GROUP BY ALL),
sc AS (SELECT dv.*, coalesce(({x} - lo) / nullif(hi - lo, 0), 0) AS s, {cuts} FROM dv JOIN kn USING (cohort, stratum)),
basis AS (SELECT cohort, stratum, {x}, {', '.join(cols)} FROM sc)"""


# The given coefficients of a wide, skewed distribution, cut at zero well inside its range.
_CUT = [
    ("mu", "(Intercept)", 25.0), ("mu", "ns1", 3.0), ("mu", "ns2", -0.4), ("sigma", "(Intercept)", -0.8), ("sigma", "ns1", 0.1),
    ("sigma", "ns2", 0.02), ("nu", "(Intercept)", -0.9), ("nu", "ns1", 0.05), ("nu", "ns2", 0.1),
]
SPLINE = COHORT + _spline("age", 2, "ns")
GIVEN = SPLINE + f""", given(param, term, beta) AS ({values(GIVEN_CENTILE_COEFFICIENTS)}),
long AS (SELECT cohort, stratum, age, unnest(['(Intercept)', 'ns1', 'ns2']) AS term, unnest([1e0, ns1, ns2]) AS value FROM basis),
pred AS (SELECT cohort, stratum, age, param, sum(beta * value) AS estimate FROM long JOIN given USING (term) GROUP BY ALL)"""


def replicates(reps: int) -> str:
    return COHORT + f""", rp AS (
  SELECT cohort, stratum, age, boot, 22 + 0.08e0 * age + 0.01e0 * (boot * 7 % 11) AS mu,
    0.14e0 + 0.001e0 * (boot * 3 % 7) AS sigma, CASE WHEN boot = 13 THEN 0e0 ELSE -0.8e0 + 0.05e0 * (boot * 5 % 9) END AS nu
  FROM (SELECT DISTINCT cohort, stratum, age FROM st), (SELECT unnest(range({reps + 1}))::INT AS boot))"""


def lms(z: str) -> str:
    return f"(CASE WHEN nu = 0 THEN mu * exp(sigma * {z}) ELSE mu * power(1 + nu * sigma * {z}, 1 / nu) END)"


def ci(by: str, source: str, value: str = "value") -> str:
    return f"""SELECT {by}, round(max({value}) FILTER (boot = 0), 6) AS beta,
  round(quantile_cont({value}, 0.025) FILTER (boot > 0), 6) AS lci,
  round(quantile_cont({value}, 0.975) FILTER (boot > 0), 6) AS uci, count({value}) FILTER (boot > 0) AS n_used,
  count(*) FILTER (boot > 0 AND {value} IS NULL) AS n_failed FROM {source} GROUP BY {by}"""


CENTILES = f"zs(centile, z) AS ({values([(p, NormalDist().inv_cdf(p / 100)) for p in range(1, 100)])})"
CURVES = replicates(20) + f""", {CENTILES}, cv AS (SELECT *, {lms('z')} AS value FROM rp, zs),
curve AS ({ci('cohort, stratum, age, centile', 'cv')})"""
PARAMS = replicates(20) + f""", lp AS (SELECT cohort, stratum, age, boot, unnest(['mu', 'sigma', 'nu']) AS parameter, unnest([mu, sigma, nu]) AS value FROM rp),
pc AS ({ci('cohort, stratum, age, parameter', 'lp')})"""

_PAIRS = [(25, 75), (10, 90), (50, 90)]
_inv = NormalDist().inv_cdf

SAMPLES = ADULT + f""", sx AS (SELECT * EXCLUDE (sex), unnest([lower(sex), 'all']) AS sex FROM adult),
smp(cohort_y, last_year) AS (VALUES (1, 2014), (1, 2019), (5, 2019)),
s0 AS (
  SELECT sx.* EXCLUDE (birth), cohort_y, last_year, {band('birth', 'cohort_y')}::INT AS birth,
    (age - min(age) OVER w) / (max(age) OVER w - min(age) OVER w)::DOUBLE AS age_s
  FROM sx, smp WHERE year <= last_year WINDOW w AS (PARTITION BY sex, cohort_y, last_year)),
s1 AS (SELECT * FROM s0 WINDOW w AS (PARTITION BY sex, cohort_y, last_year, birth) QUALIFY min(age) OVER w <= 60 AND max(age) OVER w >= 24),
s2 AS (SELECT *, wt_int * count(*) OVER w / sum(wt_int) OVER w AS w FROM s1 WINDOW w AS (PARTITION BY sex, cohort_y, last_year, year))"""

BOOT = COHORT + ", br AS (SELECT stratum, row_id, bmi, wt_int FROM st)"


def exact(reps: int) -> str:
    return BOOT + f""", rk AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY row_id) AS idx, count(*) OVER (PARTITION BY stratum) AS n FROM br),
hx AS (SELECT *, {_hash('exact', "'1'", 'stratum', 'row_id', 'block')} AS h FROM rk, (SELECT unnest(range({reps // 4 + 1})) AS block)),
pk AS (SELECT stratum, row_id, bmi, wt_int, idx, n, block * 4 + word + 1 AS boot,
         {poisson(f"((('0x' || substr(h, 1 + 8 * word, 8))::BIGINT + 0.5e0) / {float(16**8)!r})")} AS k
       FROM hx, (SELECT unnest(range(4)) AS word) WHERE block * 4 + word < {reps}),
gp AS (SELECT stratum, boot, n, (n - sum(k))::BIGINT AS gap FROM pk GROUP BY stratum, boot, n),
dr AS (SELECT *, unnest(range(1, 1 + CASE WHEN gap > 0 THEN gap WHEN gap < 0 THEN 14 * (40 - 2 * gap) ELSE 0 END)) AS d FROM gp),
du AS (SELECT *, {uniform('fill', "'1'", 'stratum', 'boot', 'd')} AS u FROM dr),
nm AS (SELECT stratum, boot, gap, floor(u * (n * 14))::BIGINT AS unit, min(d) AS d FROM du WHERE gap < 0 GROUP BY ALL),
od AS (SELECT nm.*, pk.idx, row_number() OVER (PARTITION BY nm.stratum, nm.boot ORDER BY nm.d) AS o FROM nm
       JOIN pk ON pk.stratum = nm.stratum AND pk.boot = nm.boot AND pk.idx = nm.unit // 14 + 1 WHERE nm.unit % 14 < pk.k),
ct AS (SELECT stratum, boot, 1 + floor(u * n)::BIGINT AS idx, count(*) AS more FROM du WHERE gap > 0 GROUP BY ALL
       UNION ALL SELECT stratum, boot, idx, -count(*) FROM od WHERE o <= -gap GROUP BY ALL),
bo AS (SELECT stratum, 0 AS boot, row_id, bmi, wt_int, 1 AS k FROM br
       UNION ALL SELECT stratum, boot, row_id, bmi, wt_int, (k + coalesce(more, 0))::INT AS k FROM pk LEFT JOIN ct USING (stratum, boot, idx) WHERE k + coalesce(more, 0) > 0)"""


POISSON = BOOT + f""", hx AS (SELECT *, {_hash('poisson', "'1'", 'stratum', 'row_id', 'block')} AS h FROM br, (SELECT unnest(range(50)) AS block)),
pu AS (SELECT stratum, row_id, bmi, wt_int, block * 4 + word + 1 AS boot,
        (('0x' || substr(h, 1 + 8 * word, 8))::BIGINT + 0.5e0) / {float(16**8)!r} AS u
       FROM hx, (SELECT unnest(range(4)) AS word)),
bo AS (SELECT stratum, 0 AS boot, row_id, bmi, wt_int, 1 AS k FROM br
       UNION ALL SELECT stratum, boot, row_id, bmi, wt_int, {poisson('u')} AS k FROM pu)"""
BOOT_MEAN = ", bm AS (SELECT stratum, boot, sum(k * wt_int * bmi) / sum(k * wt_int) AS value FROM bo GROUP BY ALL) " + ci("stratum", "bm")


def t_quantile(df: str) -> str:
    z = Z975
    g = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    return f"({z!r} + {g[0]!r} / {df} + {g[1]!r} / power({df}, 2) + {g[2]!r} / power({df}, 3))"


def posterior(imps: int) -> str:
    """Draws around the given fit: Cholesky factors of the fixed and the ridged group covariance."""
    f11, g11 = 0.1, (0.04 + 1e-6) ** 0.5
    f21, g21 = -0.004 / f11, -0.01 / g11
    f22, g22 = (0.02 - f21**2) ** 0.5, (0.05 + 1e-6 - g21**2) ** 0.5
    f = [normal(f"fixed{i}", "'1'", "imp") for i in (0, 1)]
    g = [normal(f"group{i}", "'1'", "imp", "birth") for i in (0, 1)]
    return FRAME + f""", po AS (
  SELECT imp, birth, 27 + {f11!r} * {f[0]} + ((birth % 7) - 3) * 0.1e0 + {g11!r} * {g[0]} AS a0,
    2.5e0 + {f21!r} * {f[0]} + {f22!r} * {f[1]} + ((birth % 5) - 2) * 0.1e0 + {g21!r} * {g[0]} + {g22!r} * {g[1]} AS a1
  FROM (SELECT DISTINCT birth FROM frame), (SELECT unnest(range(1, {imps + 1}))::INT AS imp)),
yh AS (SELECT imp, frame.*, a0 + a1 * age_s + 4.4e0 * {normal('residual', "'1'", 'imp', 'row_id')} AS yhat FROM frame JOIN po USING (birth))"""


def matched(imps: int) -> str:
    pick = uniform("donor", "'1'", "r.imp", "r.row_id")
    return posterior(imps) + f""", near AS (
  SELECT r.imp, r.row_id, d.bmi AS y, row_number() OVER (PARTITION BY r.imp, r.row_id ORDER BY abs(d.yhat - r.yhat), d.yhat > r.yhat, d.bmi) AS nth,
    floor({pick} * 5)::INT + 1 AS pick
  FROM (SELECT * FROM yh WHERE NOT obs) r JOIN (SELECT * FROM yh WHERE obs) d ON r.imp = d.imp
  QUALIFY nth <= 5),
imputed AS (SELECT imp, row_id, y AS imputed FROM near WHERE nth = pick)"""


_SUMS = """count(*)::DOUBLE AS n, round(sum({w}), 6) AS sw, round(sum({w} * age_s), 6) AS swx, round(sum({w} * age_s * age_s), 6) AS swxx,
  round(sum({w} * {y}), 6) AS swy, round(sum({w} * {y} * age_s), 6) AS swxy, round(sum({w} * {y} * {y}), 6) AS swyy, round(sum(ln({w})), 6) AS slw"""

def _cdf_series(t: str, terms: int = 60) -> str:
    """Normal distribution function by its power series around zero."""
    text, odd = "0e0", [1.0]
    for k in range(1, terms):
        odd.append(odd[-1] / (2 * k + 1))
    for c in reversed(odd):
        text = f"({c!r} + {t} * {t} * {text})"
    return f"(0.5e0 + {t} * exp(-{t} * {t} / 2) / sqrt(2 * pi()) * {text})"


def _score(given) -> str:
    """Log-likelihood, score and observed information per row at given coefficients."""
    eta = {p: " + ".join(f"{b!r} * {'1e0' if t == '(Intercept)' else t}" for q, t, b in given if q == p) for p in ("mu", "sigma", "nu")}
    return SPLINE + f""", rr AS (
  SELECT stw.*, ns1, ns2, {eta['mu']} AS m, exp({eta['sigma']}) AS s, {eta['nu']} AS v FROM stw JOIN basis USING (cohort, stratum, age)),
tt AS (SELECT *, power(bmi / m, v) AS u, ln(bmi / m) AS lg, 1 / (s * abs(v)) AS t FROM rr),
pp AS (SELECT *, CASE WHEN t > 6 THEN 1e0 ELSE {_cdf_series('t')} END AS pt FROM tt),
zz AS (SELECT *, (u - 1) / (v * s) AS z, CASE WHEN t > 6 THEN 0e0 ELSE exp(-t * t / 2) / sqrt(2 * pi()) / pt END AS h FROM pp),
qq AS (SELECT *, ((1 + v * s * z) * lg / s - z) / v AS zv, h * t AS e, h * t * (1 - t * t - t * h) AS f FROM zz),
gg AS (SELECT *, -0.5e0 * ln(2 * pi()) + (v - 1) * ln(bmi) - v * ln(m) - ln(s) - z * z / 2 - ln(pt) AS ll,
  (z / s + v * (z * z - 1)) / m AS g0, z * z - 1 + e AS g1, lg - z * zv + e / v AS g2,
  (power(u / s, 2) + z * u * (1 + v) / s - v) / power(m, 2) AS i00, 2 * z * u / (m * s) AS i01, (1 - u * zv / s - z * u * lg / s) / m AS i02,
  2 * z * z + f AS i11, f / v - 2 * z * zv AS i12, zv * zv + z * (u * lg * lg / s - 2 * zv) / v + (e + f) / (v * v) AS i22 FROM qq)"""


def _score_sums() -> str:
    """All gradient and information sums of a pass with two terms."""
    x = ["1", "ns1", "ns2"]
    cols = ["round(sum(w), 4) AS sum_w"] + [f"round(sum(w * g{b} * {x[i]}), 4) AS g{b}_{i}" for b in range(3) for i in range(3)]
    pairs = ("00", "01", "02", "11", "12", "22")
    cols += [f"round(sum(w * i{k} * {x[i]} * {x[j]}), 4) AS i{k}_{i}_{j}" for k in pairs for i in range(3) for j in range(i, 3)]
    return ", ".join(cols)


def _score_pass(given) -> str:
    return _score(given) + f"SELECT cohort, stratum, count(*) AS n, round(sum(w * ll), 4) AS loglik, {_score_sums()} FROM gg GROUP BY ALL"


def _eliminated(source: str) -> str:
    """CTE ``gj``: Gauss-Jordan steps on the matrix ``m`` of the source, beside it an identity and a right side."""
    return f"""gj AS (SELECT 1 AS step, m FROM {source} UNION ALL
  SELECT step + 1, list_transform(m, lambda line, pos: CASE WHEN pos = step THEN list_transform(line, lambda x: x / m[step][step])
    ELSE list_transform(line, lambda x, c: x - line[step] / m[step][step] * m[step][c]) END) FROM gj WHERE step <= len(m)),
sv AS (SELECT m, len(m) AS size FROM gj ORDER BY step DESC LIMIT 1)"""


# Birth years are eliminated; the first survey year is the reference of the rest.
_TWO_FACTORS = MISSING + f""", ce AS (SELECT birth AS i, year AS j, count(*)::DOUBLE AS n, sum(miss_bmi)::DOUBLE AS sy FROM miss GROUP BY ALL),
li AS (SELECT i, sum(n) AS ni, sum(sy) AS yi FROM ce GROUP BY i),
lv AS (SELECT j, nj, v, row_number() OVER (ORDER BY j) - 1 AS r FROM (SELECT j, sum(n) AS nj, sum(sy - n * yi / ni) AS v FROM ce JOIN li USING (i) GROUP BY j)),
sj AS (SELECT a.j, b.j AS k, sum(a.n * b.n / ni) AS s FROM ce a JOIN ce b USING (i) JOIN li USING (i) GROUP BY ALL),
ln AS (SELECT a.r, any_value(a.v) AS v, list(CASE WHEN a.r = b.r THEN a.nj ELSE 0e0 END - coalesce(s, 0e0) ORDER BY b.r) AS line
  FROM lv a JOIN lv b ON b.r > 0 LEFT JOIN sj ON sj.j = a.j AND sj.k = b.j WHERE a.r > 0 GROUP BY a.r),
mat AS (SELECT list(list_concat(line, list_transform(range(1, len(line) + 1), lambda q: (q = r)::INT::DOUBLE), [v]) ORDER BY r) AS m FROM ln),
{_eliminated('mat')},
ef AS (SELECT j, r, coalesce(m[r][2 * size + 1], 0e0) AS b FROM lv, sv),
gg AS (SELECT a.j, b.j AS k, m[a.r][size + b.r] AS g FROM lv a, lv b, sv WHERE a.r > 0 AND b.r > 0),
ss AS (SELECT (SELECT sum(miss_bmi) FROM miss) - (SELECT sum(yi * yi / ni) FROM li) - (SELECT sum(b * v) FROM ef JOIN lv USING (j)) AS rss,
  (SELECT sum(n) FROM ce) - (SELECT count(*) FROM li) - (SELECT count(*) - 1 FROM lv) AS dof),
mz AS (SELECT i, j, coalesce(n, 0) / ni - coalesce(n0 / ni0, 0) AS p FROM (SELECT i, j, ni FROM li, lv) LEFT JOIN ce USING (i, j)
  LEFT JOIN (SELECT j, n AS n0, ni AS ni0 FROM ce JOIN li USING (i) WHERE i = (SELECT min(i) FROM li)) USING (j)),
qv AS (SELECT a.i, sum(a.p * b.p * g) AS w FROM mz a JOIN mz b USING (i) JOIN gg ON gg.j = a.j AND gg.k = b.j GROUP BY a.i),
qm AS (SELECT i, sum(p * b) AS d FROM mz JOIN ef USING (j) GROUP BY i),
fb AS (SELECT i AS i0, ni AS n0, yi AS y0 FROM li ORDER BY i LIMIT 1),
es AS (
  SELECT 'year' AS factor, j AS level, b AS estimate, g AS var FROM ef JOIN gg USING (j) WHERE gg.k = j
  UNION ALL SELECT 'birth', i, yi / ni - y0 / n0 - d, 1 / ni + 1 / n0 + w FROM li JOIN qv USING (i) JOIN qm USING (i), fb WHERE i <> i0),
fi AS (SELECT factor, level::BIGINT AS level, estimate, sqrt(var * rss / dof) AS se, {{t}} AS t FROM es, ss)
SELECT factor, level, round(estimate, 6) AS estimate, round(se, 6) AS se, round(estimate - t * se, 6) AS conf_low, round(estimate + t * se, 6) AS conf_high FROM fi"""
_SPLINE_MEAN = MISSING + ", st AS (SELECT 0 AS cohort, 'all' AS stratum, age, miss_bmi FROM miss)" + _spline("age", 3, "ns") + f""", ce AS (
  SELECT age, [1e0, ns1, ns2, ns3] AS t, count(*)::DOUBLE AS n, sum(miss_bmi)::DOUBLE AS sy FROM st JOIN basis USING (age) GROUP BY ALL),
ln AS (SELECT a AS r, list(g ORDER BY b) AS line, any_value(v) AS v FROM (
  SELECT a, b, sum(n * t[a] * t[b]) AS g, sum(sy * t[a]) AS v FROM ce, (SELECT unnest(range(1, 5)) AS a), (SELECT unnest(range(1, 5)) AS b) GROUP BY a, b) GROUP BY a),
mat AS (SELECT list(list_concat(line, list_transform(range(1, 5), lambda q: (q = r)::INT::DOUBLE), [v]) ORDER BY r) AS m FROM ln),
{_eliminated('mat')},
ss AS (SELECT (SELECT sum(sy) FROM ce) - (SELECT sum(v * m[r][9]) FROM ln, sv) AS rss, (SELECT sum(n) FROM ce) - 4 AS dof),
pr AS (SELECT age, list_sum(list_transform(range(1, 5), lambda a: t[a] * m[a][9])) AS predicted,
  sqrt(list_sum(list_transform(range(1, 5), lambda a: list_sum(list_transform(range(1, 5), lambda b: t[a] * t[b] * m[a][4 + b])))) * rss / dof) AS se, dof FROM ce, sv, ss),
fi AS (SELECT *, {{t}} AS t FROM pr)
SELECT age::DOUBLE AS age, round(predicted, 6) AS predicted, round(se, 6) AS se, round(predicted - t * se, 6) AS conf_low, round(predicted + t * se, 6) AS conf_high FROM fi"""

_SPECS = f"""specs AS (
  SELECT row_number() OVER (ORDER BY so, cohort_y, last_year, oo, ro)::INT AS spec_id, sex, cohort_y, last_year, outcome, ran_pars
  FROM (VALUES (1, 'male'), (2, 'female'), (3, 'all')) a(so, sex), (VALUES (1), (5)) b(cohort_y), (VALUES (2014), (2019)) c(last_year),
       (VALUES (1, 'bmi'), (2, 'obese')) d(oo, outcome), (VALUES (1, '1 + age_s'), (2, '-1 + age_s')) e(ro, ran_pars)
  WHERE cohort_y = 1 OR last_year = 2019)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1).replace("{t}", t_quantile("dof"))


def _clean_rows(where: str = "") -> str:
    return f"SELECT row_id, year, sex, age, round(bmi, 6) AS bmi, edu, round(wt_int, 6) AS wt_int, birth FROM clean{where}"


ORACLE = {
    "harmonised_rows": CLEAN + _clean_rows(),
    "harmonised_by_year": CLEAN + """SELECT year, count(*) AS n, count(bmi) AS n_bmi, count(age) AS n_age, count(edu) AS n_edu,
  round(sum(bmi), 6) AS sum_bmi, round(sum(wt_int), 6) AS sum_wt FROM clean GROUP BY year""",
    "wave_files_by_year": CLEAN + """SELECT year, count(*) AS n, count(bmi) AS n_bmi, count(age) AS n_age, count(edu) AS n_edu,
  count(*) AS n_ids, round(sum(bmi), 6) AS sum_bmi, round(sum(wt_int), 6) AS sum_wt FROM clean WHERE year >= 2000 GROUP BY year""",
    "dictionary": """SELECT table_name, column_name AS name, '' AS label FROM information_schema.columns WHERE table_name IN (
  'region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark',
  'labels', 'conversations')""",
    "wave_union": f"""WITH {RAW} SELECT wave, count(*) AS n, count(CASE WHEN wave <= 2013 THEN age1 END) AS n_age,
  count(CASE WHEN wave = 2014 THEN age90 END) AS n_age90, count(CASE WHEN wave >= 2015 THEN code END) AS n_age35g,
  count(CASE WHEN wave <= 1997 THEN eth END) AS n_ethnic, count(CASE WHEN wave BETWEEN 2003 AND 2013 THEN samptype END) AS n_samptype,
  count(CASE WHEN wave >= 2003 THEN rawwt END) AS n_wt FROM raw GROUP BY wave""",
    "pruned_scan": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "file_ranks": """SELECT o_custkey AS fld, o_orderkey AS path, count(*) OVER (PARTITION BY o_custkey) AS fld_files,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS fld_rank FROM orders""",
    "band_age_draw": f"""WITH {RAW}, bands(bcode, lo, hi) AS ({values(_BANDS)})
SELECT row_id, code AS age35g, lo, hi, (lo + floor({uniform('band_age', "'1'", 'row_id')} * (hi - lo + 1)))::INT AS age
FROM raw LEFT JOIN bands ON code = bcode WHERE wave >= 2015 AND code IS NOT NULL""",
    "uniform_draws": CLEAN + f"""SELECT row_id, round({uniform('demo', "'1'", 'row_id')}, 6) AS u,
  round({normal('demo', "'1'", 'row_id')}, 6) AS z, {poisson(uniform('demo', "'1'", 'row_id'))}::INT AS k FROM clean""",
    "cohort_counts": COHORT + "SELECT cohort, sex, count(*) AS n FROM cohorts GROUP BY ALL",
    "followup_kept": MISSING + "SELECT birth, count(*) AS n, min(age) AS min_age, max(age) AS max_age FROM miss GROUP BY birth",
    "stratum_sizes": AGEBAND + "SELECT cohort, stratum, count(*) AS n, cohort || '-' || (cohort + 4) AS label FROM st GROUP BY ALL",
    "normalised_weights": COHORT + "SELECT cohort, stratum, row_id, round(w, 6) AS w FROM stw",
    "weights_null_policy": CLEAN + """, wn AS (SELECT year, CASE WHEN row_id % 11 <> 0 THEN wt_int END AS w0 FROM clean),
fs AS (SELECT year, CASE WHEN count(*) = count(w0) THEN count(*) / sum(w0) END AS fp, count(w0) / sum(w0) AS fk FROM wn GROUP BY year)
SELECT year, count(w0 * fp) AS n_w, round(sum(w0 * fp), 6) AS sum_w, 'propagate' AS policy FROM wn JOIN fs USING (year) GROUP BY year
UNION ALL SELECT year, count(w0 * fk), round(sum(w0 * fk), 6), 'skip' FROM wn JOIN fs USING (year) GROUP BY year""",
    "weighted_mean_by_stratum": COHORT + """SELECT cohort, stratum, year, count(*) AS n, round(sum(w), 6) AS sum_w,
  round(sum(w * bmi) / sum(w), 6) AS mean_bmi FROM stw GROUP BY ALL""",
    "obesity_prevalence": ADULT + f""", st AS (SELECT *, unnest([lower(sex), 'all']) AS stratum, {band('birth', 5)}::INT AS birth5 FROM adult)
SELECT birth5, stratum, count(bmi) AS n, sum((bmi >= 30)::INT)::BIGINT AS n_obese, sum((bmi > 30)::INT)::BIGINT AS n_over,
  round(sum(wt_int * (bmi >= 30)::INT) / sum(wt_int) FILTER (bmi IS NOT NULL), 6) AS share FROM st GROUP BY ALL""",
    "birth_age_bands": CLEAN + f""", b AS (SELECT *, {band('birth', 5)}::INT AS birth_lb FROM clean),
g AS (SELECT *, (year - birth_lb - 4)::INT AS age_lb, year - birth_lb AS age_ub FROM b)
SELECT birth_lb || '-' || (birth_lb + 4) AS birth_range, age_lb || '-' || (age_lb + 4) AS age_range, birth_lb, age_lb,
  count(*) AS n, round(avg(bmi), 6) AS mean_bmi FROM g WHERE bmi BETWEEN 9 AND 90 AND age_lb >= 20 AND age_lb % 5 = 0 AND age_ub <= 59 GROUP BY ALL""",
    "rescaled_age": ADULT + """SELECT row_id, round((age - min(age) OVER ()) / (max(age) OVER () - min(age) OVER ())::DOUBLE, 6) AS age_s,
  round((age - min(age) OVER b) / nullif((max(age) OVER b - min(age) OVER b)::DOUBLE, 0), 6) AS age_b FROM adult WINDOW b AS (PARTITION BY birth)""",
    "right_join_age_grid": ADULT + """SELECT age, count(h.row_id) AS n, round(max(h.bmi), 6) AS max_bmi
FROM (SELECT row_id, age, bmi FROM clean) h RIGHT JOIN (SELECT DISTINCT age FROM adult) USING (age) GROUP BY age""",
    "completeness_profile": CLEAN + """SELECT unnest(['year', 'sex', 'age', 'bmi', 'edu', 'wt_int', 'birth']) AS variable,
  unnest([count(year), count(sex), count(age), count(bmi), count(edu), count(wt_int), count(birth)]) AS n_valid,
  unnest([round(100e0 * c / count(*), 6) for c in [count(year), count(sex), count(age), count(bmi), count(edu), count(wt_int), count(birth)]]) AS pct_valid FROM clean""",
    "observed_share": MISSING + "SELECT count(*) AS n_all, count(bmi) AS n_obs, round(100e0 * count(bmi) / count(*), 6) AS pct FROM miss",
    "count_summary": ADULT + """, f AS (SELECT year, count(*) AS n FROM adult WHERE birth IN (SELECT birth FROM adult GROUP BY birth HAVING max(age) >= 24 AND min(age) <= 70) GROUP BY year)
SELECT min(n) AS min_n, round(quantile_cont(n, 0.25), 6) AS q1, round(quantile_cont(n, 0.5), 6) AS median, round(avg(n), 6) AS mean,
  round(quantile_cont(n, 0.75), 6) AS q3, max(n) AS max_n,
  (SELECT year FROM f ORDER BY n DESC, year LIMIT 1) AS first_key, (SELECT year FROM f ORDER BY n, year DESC LIMIT 1) AS last_key FROM f""",
    "weighted_variance": MISSING + """, st AS (SELECT *, unnest([lower(sex), 'all']) AS stratum FROM miss WHERE bmi IS NOT NULL),
m AS (SELECT stratum, sum(wt_int) AS sw, sum(wt_int * bmi) / sum(wt_int) AS mean FROM st GROUP BY stratum),
v AS (SELECT stratum, sum(wt_int * (bmi - mean) * (bmi - mean)) / (any_value(sw) - 1) AS variance FROM st JOIN m USING (stratum) GROUP BY stratum)
SELECT stratum, round(sw, 6) AS sum_w, round(mean, 6) AS mean, round(variance, 6) AS variance, round(sqrt(variance), 6) AS sd FROM m JOIN v USING (stratum)""",
    "education_shares": CLEAN + f", o(edu_order, edu) AS ({values(_EDU)}) SELECT edu, count(*) AS n, edu_order FROM clean JOIN o USING (edu) GROUP BY ALL",
    "scalar_functions": CLEAN + f"""SELECT row_id, lower(sex) AS low, sex AS title, right('factor(year)' || year, 4)::INT AS last4,
  replace(edu, 'NVQ', 'Level ') AS edu_text, regexp_matches(edu, 'NVQ[0-9]') AS is_nvq, string_split(edu, ' ')[1] AS edu_head,
  {band('birth', 10)} || '-' || ({band('birth', 10)} + 9) AS decade, age || 'th' AS cent, 'Age ' || age AS age_label,
  CASE WHEN age - 40 < 0 THEN '' ELSE '+ ' END || (age - 40) || ' kg/m2' AS signed,
  round(1 / (1 + exp(-(age - 40) / 10e0)), 6) AS prob, round(sqrt(abs(age - 40)), 6) AS root FROM clean""",
    "spline_basis": SPLINE + "SELECT cohort, stratum, age, round(ns1, 6) AS ns1, round(ns2, 6) AS ns2 FROM basis",
    "spline_basis_year": AGEBAND + _spline("year", 3, "ns") + """
SELECT cohort, stratum, year, round(ns1, 6) AS ns1, round(ns2, 6) AS ns2, round(ns3, 6) AS ns3 FROM basis""",
    "poly_basis": ADULT + """, dv AS (SELECT DISTINCT age::DOUBLE AS age FROM adult), d AS (SELECT age, age - avg(age) OVER () AS x FROM dv),
r AS (SELECT age, x, x * x - sum(x * x * x) OVER () / sum(x * x) OVER () * x - avg(x * x) OVER () AS q FROM d)
SELECT age, round(x / sqrt(sum(x * x) OVER ()), 6) AS p1, round(q / sqrt(sum(q * q) OVER ()), 6) AS p2 FROM r""",
    "poly_basis_by_cohort": ADULT + f""", dv AS (SELECT DISTINCT {band('birth', 10)}::INT AS cohort, age::DOUBLE AS age FROM adult),
d AS (SELECT cohort, age, age - avg(age) OVER w AS x, count(*) OVER w AS n FROM dv WINDOW w AS (PARTITION BY cohort)),
r AS (SELECT cohort, age, x, n, CASE WHEN n > 2 THEN x * x - sum(x * x * x) OVER w / sum(x * x) OVER w * x - avg(x * x) OVER w END AS q FROM d WINDOW w AS (PARTITION BY cohort))
SELECT cohort, age, CASE WHEN n > 1 THEN round(x / sqrt(sum(x * x) OVER w), 6) END AS p1, CASE WHEN n > 2 THEN round(q / sqrt(sum(q * q) OVER w), 6) END AS p2
FROM r WINDOW w AS (PARTITION BY cohort)""",
    "price_quantiles": "SELECT l_returnflag, l_linestatus, " + ", ".join(
        f"round(quantile_cont(l_extendedprice, {p}), 6) AS {n}" for n, p in (("p1", 0.01), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("p99", 0.99))
    ) + " FROM lineitem GROUP BY ALL",
    "measure_quantiles": COHORT + "SELECT cohort, stratum, " + ", ".join(f"round(quantile_cont(bmi, {p / 100}), 6) AS c{p}" for p in (10, 25, 50, 75, 90)) + " FROM st GROUP BY ALL",
    "linear_predictor": GIVEN + "SELECT cohort, stratum, age, param, round(estimate, 6) AS estimate FROM pred",
    "params_wide": GIVEN + """SELECT cohort, stratum, age, round(max(estimate) FILTER (param = 'mu'), 6) AS mu,
  round(exp(max(estimate) FILTER (param = 'sigma')), 6) AS sigma, round(max(estimate) FILTER (param = 'nu'), 6) AS nu FROM pred GROUP BY ALL""",
    "lms_centiles": CURVES + "SELECT * FROM curve",
    "centile_contrast": replicates(20) + f""", pr(comp, lo, hi) AS ({values([(f'{h}th vs {l}th', _inv(l / 100), _inv(h / 100)) for l, h in _PAIRS])}),
df AS (SELECT *, {lms('hi')} - {lms('lo')} AS value FROM rp, pr) {ci('cohort, stratum, age, comp', 'df')}""",
    "parameter_interval": PARAMS + "SELECT * FROM pc",
    "centile_log_link": replicates(0) + f""", {CENTILES} SELECT cohort, stratum, age, centile,
  round(CASE WHEN 1 + 0.54e0 * z > 0 THEN mu * power(CASE WHEN 1 + 0.54e0 * z > 0 THEN 1 + 0.54e0 * z END, 1 / 0.6e0) END, 6) AS value
FROM rp, zs WHERE centile IN (2, 5, 10, 50, 90, 95, 98)""",
    "uncoded_levels": CLEAN + """SELECT stratum, edu AS term, round(avg(bmi), 6) AS beta
FROM (SELECT *, unnest([lower(sex), 'all']) AS stratum FROM clean WHERE edu IS NOT NULL) GROUP BY ALL""",
    "lms_score_pass": _score_pass(GIVEN_CENTILE_COEFFICIENTS),
    "lms_score_pass_cut": _score_pass(_CUT),
    "bootstrap_counts": exact(10) + "SELECT stratum, boot::INT AS boot, row_id, k::INT AS k FROM bo",
    "bootstrap_mean_ci": exact(50) + BOOT_MEAN,
    "poisson_mean_ci": POISSON + BOOT_MEAN,
    "replicate_interval": CLEAN + f""", yr AS (SELECT {band('birth', 10)}::INT AS cohort, year - 1991 AS boot, avg(bmi) AS value FROM clean WHERE birth IS NOT NULL GROUP BY ALL) """ + ci("cohort", "yr"),
    "global_ranks": CLEAN + "SELECT sex, row_id, row_number() OVER (PARTITION BY sex ORDER BY bmi, row_id) AS rank FROM clean WHERE bmi IS NOT NULL",
    "missing_by_year_ols": MISSING + f""", l AS (SELECT year AS level, count(*) AS n, avg(miss_bmi) AS m, var_pop(miss_bmi) * count(*) AS ss FROM miss GROUP BY year),
p AS (SELECT arg_min(n, level) AS n0, arg_min(m, level) AS m0, min(level) AS l0, sum(n) - count(*) AS dof, sum(ss) / (sum(n) - count(*)) AS s2 FROM l),
e AS (SELECT level, n, m - m0 AS estimate, sqrt(s2 * (1e0 / n + 1e0 / n0)) AS se, {t_quantile('dof')} AS t FROM l, p WHERE level <> l0)
SELECT level, n, round(estimate, 6) AS estimate, round(se, 6) AS se, round(estimate - t * se, 6) AS conf_low, round(estimate + t * se, 6) AS conf_high FROM e""",
    "missing_two_factor_ols": _recursive(_TWO_FACTORS),
    "missing_spline_ols": _recursive(_SPLINE_MEAN),
    "spec_sample_sizes": SAMPLES + f""", {_SPECS}, z AS (SELECT sex, cohort_y, last_year, count(*) AS n_all, count(bmi * w) AS n_used, count(DISTINCT birth) AS n_birth,
  round(sum(w), 6) AS sum_w FROM s2 GROUP BY ALL) SELECT * FROM specs JOIN z USING (sex, cohort_y, last_year)""",
    "mixed_suffstats": SAMPLES + "SELECT sex, cohort_y, last_year, birth, " + _SUMS.format(w="w", y="bmi") + " FROM s2 WHERE bmi IS NOT NULL AND w IS NOT NULL GROUP BY ALL",
    "binary_cells": SAMPLES + """SELECT sex, cohort_y, last_year, birth, round(age_s, 6) AS age_s, count(*)::DOUBLE AS n, round(sum(w), 6) AS sw,
  round(sum(CASE WHEN bmi >= 30 THEN w ELSE 0 END), 6) AS swo FROM s2 WHERE bmi IS NOT NULL AND w IS NOT NULL GROUP BY sex, cohort_y, last_year, birth, s2.age_s""",
    "lmm_trajectories": FRAME + """, st AS (SELECT unnest([lower(sex), 'all']) AS stratum, frame.birth, frame.age, age_s FROM frame JOIN miss USING (row_id)),
rg AS (SELECT stratum, birth, min(age) AS lo, max(age) AS hi FROM st GROUP BY ALL),
ag AS (SELECT stratum, birth, unnest(range(lo, hi + 1))::INT AS age FROM rg),
ds AS (SELECT DISTINCT stratum, age, age_s FROM st),
ev AS (SELECT ag.stratum, birth, ag.age, -0.9e0 + CASE WHEN birth % 5 <> 0 THEN ((birth % 7) - 3) * 0.1e0 ELSE 0 END
  + (0.8e0 + CASE WHEN birth % 5 <> 0 THEN ((birth % 5) - 2) * 0.1e0 ELSE 0 END) * age_s AS eta FROM ag LEFT JOIN ds USING (stratum, age))
SELECT stratum, birth, age, round(1 / (1 + exp(-eta)), 6) AS estimate FROM ev""",
    "random_effect_ci": MISSING + f""", g AS (SELECT stratum, birth, avg(bmi) - 27 AS e, 4 / sqrt(count(*)) AS se
  FROM (SELECT *, unnest([lower(sex), 'all']) AS stratum FROM miss WHERE bmi IS NOT NULL) GROUP BY ALL)
SELECT stratum, birth, unnest(['Random Intercept', 'Random Slope']) AS term_clean, round(e, 6) AS ranef, round(e - {Z975!r} * se, 6) AS lci, round(e + {Z975!r} * se, 6) AS uci FROM g""",
    "observed_range": MISSING + """, st AS (SELECT birth, age, unnest([lower(sex), 'all']) AS stratum FROM miss),
rg AS (SELECT stratum, birth, min(age) AS lo, max(age) AS hi FROM st GROUP BY ALL)
SELECT stratum, birth, unnest(range(lo, hi + 1))::INT AS age FROM rg""",
    "nested_counts": COHORT + """, ac AS (SELECT cohort, stratum, age, count(*) AS n FROM st GROUP BY ALL)
SELECT cohort, stratum, (count(*) OVER (PARTITION BY cohort, stratum))::INT AS ages, age, n FROM ac""",
    "pooled_means": posterior(10) + """, ce AS (SELECT imp, birth, age, avg(yhat) AS pred FROM yh GROUP BY ALL)
SELECT birth, age, round(avg(pred), 6) AS pred FROM ce GROUP BY ALL""",
    "imputation_frame": FRAME + "SELECT row_id, round(bmi, 6) AS bmi, round(age_s, 6) AS age_s, age, birth, round(wt_int, 6) AS wt_int, obs FROM frame",
    "posterior_draws": posterior(10) + "SELECT imp, birth, round(a0, 6) AS a0, round(a1, 6) AS a1, 4.4e0 AS sigma FROM po",
    "noisy_predictions": posterior(10) + "SELECT imp, row_id, round(yhat, 6) AS yhat FROM yh",
    "pmm_impute": matched(10) + "SELECT imp, row_id, round(imputed, 6) AS imputed FROM imputed",
    "delta_suffstats": matched(10) + """, al AS (SELECT imp, birth, wt_int, age_s, bmi AS y, 0 AS shifted FROM yh WHERE obs
  UNION ALL SELECT imp, birth, wt_int, age_s, imputed, 1 FROM yh JOIN imputed USING (imp, row_id)),
sh AS (SELECT diff, imp, birth, wt_int, age_s, y + shifted * diff AS y FROM al, (SELECT unnest(range(-5, 6))::DOUBLE AS diff))
SELECT diff, imp, birth, """ + _SUMS.format(w="wt_int", y="y") + " FROM sh GROUP BY ALL",
    "lms_fit_certificate": COHORT + """SELECT cohort, stratum, count(*) AS n, true AS converged, true AS concave, 0e0 AS slope, 'age' AS over
FROM st GROUP BY ALL HAVING count(*) >= 100 UNION ALL SELECT cohort, stratum, count(*), true, true, 0e0, 'year' FROM (
  SELECT cohort, unnest([lower(sex), 'all']) AS stratum FROM (SELECT *, """ + band("age", 5) + """::INT AS cohort FROM adult WHERE bmi IS NOT NULL)) GROUP BY ALL HAVING count(*) >= 100""",
    "figure_feed": CURVES + """SELECT cohort || '-' || (cohort + 9) AS cohort, upper(stratum[1]) || stratum[2:] AS stratum, age, centile || 'th' AS centile, beta, lci, uci, n_used, n_failed
FROM curve WHERE centile IN (10, 25, 50, 75, 90)""",
    "age_figure_feed": CURVES + """SELECT cohort || '-' || (cohort + 9) AS cohort, upper(stratum[1]) || stratum[2:] AS stratum, 'Age ' || age AS age_f, centile, beta, lci, uci, n_used, n_failed
FROM curve WHERE age IN (25, 35, 45, 55)""",
    "parameter_figure_feed": PARAMS + """SELECT cohort || '-' || (cohort + 9) AS cohort, upper(stratum[1]) || stratum[2:] AS stratum, age,
  CASE parameter WHEN 'mu' THEN 'Median' WHEN 'sigma' THEN 'CoV' ELSE 'Skewness' END AS param_clean,
  CASE parameter WHEN 'mu' THEN 1 WHEN 'sigma' THEN 2 ELSE 3 END AS param_order, beta, lci, uci, n_used, n_failed FROM pc""",
    "category_lines": CURVES + """SELECT DISTINCT centile || 'th' AS centile, bmi, label
FROM curve, (VALUES (18.5e0, 'Normal'), (25e0, 'Overweight'), (30e0, 'Obese')) v(bmi, label) WHERE centile IN (10, 25, 50, 75, 90)""",
}
