"""Claims: a phrase grammar over texts, vector and graph evidence, verdicts of three layers and their measures.

The grammar is a table: a connective phrase, what it says of its two ends, and
its priority. Every run of words of a claim meets the table in an equi-join; the
first priority, then the earliest and longest phrase, decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..model import ESSENCE, FUNCTION, PRESENT, aliases, angle, concepts, r, relations, succession, undirected
from ..plans.dialect import query
from . import search

QUERIES: list = []
Q = lambda ids, **views: query(QUERIES, ids, **views)

# The words by which a claim tells its type, from the most specific to the least; a
# checker that knew other words would judge other claims.
BE, BE_PAST = ("is", "are"), ("is", "are", "was", "were")
OPPOSITE = ("opposite",)
SORTS = ("type", "kind", "form", "sort", "category")
HAPPEN = ("comes", "come", "came", "happens", "happen", "happened", "occurs", "occur", "occurred")
EARLIER, LATER = ("before", "prior to", "earlier than"), ("after", "later than")
LEADING, TRAILING = ("precedes", "precede", "preceded"), ("follows", "follow", "followed")
LIE, TENSES = ("lies", "lie", "lay"), ("past", "future", "present")
DEICTIC, DAYS = ("happened", "occurred", "happens", "happen", "occurs", "occur"), ("yesterday", "today", "tomorrow", "now")
CAUSE = ("causes", "cause", "leads to", "lead to", "produces", "produce", "creates", "create", "results in", "result in", "generates", "generate")
LOOSE = ("can", "will", "should", "must", "has", "have", "had", "does", "do", "did", "was", "were", "means", "mean", "implies", "imply", "requires", "require", "involves", "involve", "contains", "contain", "includes", "include", "represents", "represent", "symbolizes", "symbolize", "embodies", "embody", "reflects", "reflect", "denotes", "denote")
ARTICLES = ("a", "an", "the")


def grammar() -> list[tuple[int, str, str, str]]:
    """(priority, phrase, claim type, hint) of all connectives."""
    when = lambda words: [*(f"{v} {w}" for v in (*HAPPEN, *BE_PAST) for w in words), *words]
    kinds = (
        ("opposition", "opposition", [f"{b} {a}{w} of" for b in BE for a in ("the ", "") for w in OPPOSITE]),
        ("taxonomic", "affinity", [f"{b} {a}{w} of" for b in BE for a in ("a ", "") for w in SORTS]),
        ("temporal", "order_before", when(EARLIER)),
        ("temporal", "order_after", when(LATER)),
        ("temporal", "order_first", LEADING),
        ("temporal", "order_second", TRAILING),
        ("temporal", "locative", [f"{v} in the" for v in (*BE_PAST, *LIE)]),
        ("temporal", "deictic", (*DEICTIC, *BE_PAST)),
        ("causal", "affinity", CAUSE),
        ("identity", "synonym", [f"{b} {a}".strip() for b in BE for a in (*ARTICLES, "")]),
        ("freeform", "", LOOSE),
    )
    # both directions of an order are one rule: the earlier place decides between them
    rank = {"order_after": 2, "order_second": 4}
    return [(rank.get(hint, i), p, kind, hint) for i, (kind, hint, phrases) in enumerate(kinds) for p in phrases]


LONGEST = max(p.count(" ") + 1 for _, p, _, _ in grammar())


def parsed(d, source: str = "claims", to: str = "parsed"):
    """``to``: the claims (claim_id, text) of ``source`` with type, hint, subject and predicate.

    A claim without a connective is split in the middle of its words; one word is both ends.
    """
    rows = ", ".join(f"({i}, '{p}', '{k}', '{h}')" for i, p, k, h in grammar())
    tail = f"substring(lower({d.concat(d.slice('w', 'p + n', d.size('w')), ' ')}), 1, 10)"
    one_of = lambda words: ", ".join(f"'{w}'" for w in words)
    ends = lambda w, i, n: d.concat(d.slice(w, i, n), " ")
    half = f"CAST(floor({d.size('t.w')} / 2e0) AS INT)"
    return f"""{to}_tok AS (SELECT claim_id, text, {d.split("trim(" + d.rr('text', '[.!?]+$', '') + ")", " ")} AS w FROM {source}),
    {to}_at AS (SELECT claim_id, w, {d.explode(d.seq(2, f"greatest(2, {d.size('w')} - 1)"))} AS p FROM {to}_tok WHERE {d.size('w')} >= 3),
    {to}_run AS (SELECT claim_id, w, p, n, lower({d.concat(d.slice('w', 'p', 'n'), ' ')}) AS run FROM {to}_at CROSS JOIN (SELECT {d.explode(d.seq(1, LONGEST))} AS n) z WHERE p + n <= {d.size('w')}),
    {to}_grammar AS (SELECT * FROM (VALUES {rows}) AS g(prio, phrase, claim_type, hint)),
    {to}_spot AS (SELECT claim_id, w, p, n, claim_type, hint, row_number() OVER (PARTITION BY claim_id ORDER BY prio, p, n DESC) AS place FROM {to}_run JOIN {to}_grammar ON phrase = run
      WHERE (hint <> 'locative' OR {tail} IN ({one_of(TENSES)})) AND (hint <> 'deictic' OR {tail} IN ({one_of(DAYS)}))),
    {to} AS (SELECT t.claim_id, t.text, coalesce(s.claim_type, 'freeform') AS claim_type, CASE s.hint WHEN 'order_first' THEN 'order_before' WHEN 'order_second' THEN 'order_after' WHEN 'deictic' THEN 'locative' ELSE coalesce(s.hint, '') END AS hint,
      CASE WHEN p IS NOT NULL THEN {ends('s.w', '1', 'p - 1')} WHEN {d.size('t.w')} >= 2 THEN {ends('t.w', '1', half)} ELSE t.text END AS subject,
      CASE WHEN p IS NOT NULL THEN {ends('s.w', 'p + n', d.size('s.w'))} WHEN {d.size('t.w')} >= 2 THEN {ends('t.w', f'{half} + 1', d.size('t.w'))} ELSE t.text END AS predicate
      FROM {to}_tok t LEFT JOIN {to}_spot s ON s.claim_id = t.claim_id AND s.place = 1)"""


def tense(x: str) -> str:
    """The tense that a day stands for; a tense stands for itself."""
    return f"CASE lower({x}) WHEN 'yesterday' THEN 'past' WHEN 'today' THEN 'present' WHEN 'now' THEN 'present' WHEN 'tomorrow' THEN 'future' ELSE lower({x}) END"


def graph(d):
    return f"{concepts(d)}, {relations(d)}, {undirected(d)}"


#: The forms in which a relation's ends are stated.
STATED = ("is the opposite of", "is a kind of", "causes", "comes before", "is")
#: More forms, some without any connective.
MANY = ("are the opposite of", "is a", "follows", "results in", "has", "was earlier than", "was in the past with", "leads to", "beside", "requires", "precedes", "is a sort of", "occurred before", "denotes")


def claims(d, forms=STATED):
    """A claim for each relation, its form by the sum of the ends; the id is made of the ends."""
    arms = " ".join(f"WHEN {i} THEN ' {f} '" for i, f in enumerate(forms))
    return f"""claims AS (SELECT c1 * 4294967296 + c2 AS claim_id, c1, c2, rel_type, concat(p.name, CASE (c1 + c2) % {len(forms)} {arms} END, q.name) AS text FROM relations JOIN concepts p ON p.id = c1 JOIN concepts q ON q.id = c2)"""


@Q("TXT-04 SRC-10 CHK-09")
def claim_parse(d):
    """Type, hint and ends of a claim of every form, read from its text alone; blank lines and comments are no claims."""
    return f"""WITH {graph(d)}, {claims(d, STATED + MANY)}, lines AS (SELECT claim_id, CASE claim_id % 97 WHEN 0 THEN '' WHEN 1 THEN concat('# ', text) ELSE concat(text, CASE WHEN claim_id % 2 = 0 THEN '.' ELSE '' END) END AS text FROM claims),
    kept AS (SELECT * FROM lines WHERE trim(text) <> '' AND NOT {d.rx('text', '^ *#')}), {parsed(d, 'kept')}
    SELECT claim_id, claim_type, hint, subject, predicate FROM parsed"""


@Q("CHK-09")
def claim_batch_counts(d):
    """Claims of a batch by type and hint."""
    return f"WITH {graph(d)}, {claims(d, STATED + MANY)}, {parsed(d)} SELECT claim_type, hint, count(*) AS n, count(DISTINCT subject) AS subjects FROM parsed GROUP BY claim_type, hint"


@Q("TXT-05 SRC-08")
def question_to_claim(d):
    """Questions of a table with several answers in a cell, turned into statements."""
    rest = lambda n: f"substring(q, {n + 1}, length(q) - {n + 1})"
    return f"""WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN concat('What is the brand of ', p_name, '?') WHEN 1 THEN concat('What causes ', lower(p_type), ' prices?') WHEN 2 THEN concat('Is ', p_name, ' a ', lower(p_type), '?') ELSE concat('Who makes ', p_name, '?') END AS q,
      concat(p_brand, CASE WHEN p_size % 3 = 0 THEN concat('; ', p_type, ';') ELSE '' END) AS answers FROM part),
    a AS (SELECT id, q, trim(answer) AS answer FROM (SELECT id, q, {d.explode(d.split('answers', ';'))} AS answer FROM t) z WHERE trim(answer) <> '')
    SELECT id, answer, CASE WHEN {d.rx('q', '^What is ')} THEN concat(upper(substring(q, 9, 1)), {rest(9)}, ' is ', answer) WHEN {d.rx('q', '^What causes ')} THEN concat(answer, ' causes ', {rest(12)})
      WHEN {d.rx('q', '^Who ')} THEN concat(answer, ' ', {rest(4)}) ELSE concat({rest(0)}, ': ', answer) END AS claim FROM a"""


#: Endings that a term may have beside a name, and what stands in their place.
ENDINGS = tuple((s, t) for s in ("s", "es", "ed", "er", "ers", "ing", "ings", "ly", "ness", "tion", "ment", "est", "en", "al", "ful", "ity", "ous", "ish", "able", "ance", "ence", "ism", "ist", "ive") for t in ("", "e", "y"))


@Q("TXT-02 TXT-03")
def term_resolver(d):
    """Terms of texts against a vocabulary: with an article cut, the name itself, an alias, then each ending replaced; the first hit stays, and what is missed is listed."""
    rows = ", ".join(f"({i}, '{s}', {len(s)}, '{t}')" for i, (s, t) in enumerate(ENDINGS, 3))
    return f"""WITH vocab AS (SELECT DISTINCT w FROM (SELECT {d.explode(d.rall('lower(text)', '[a-z]+'))} AS w FROM benchmark) z WHERE length(w) > 2),
    aliases AS (SELECT concat(substring(w, 1, 3), 'x') AS alias, min(w) AS w FROM vocab GROUP BY substring(w, 1, 3)),
    asked0 AS (SELECT DISTINCT w FROM (SELECT {d.explode(d.rall('lower(text)', '[a-z]+'))} AS w FROM conversations) z),
    asked AS (SELECT w AS term, w AS t FROM asked0 UNION SELECT concat('the ', w), w FROM asked0 WHERE length(w) % 2 = 0 UNION SELECT concat('a ', substring(w, 1, 3), 'x'), concat(substring(w, 1, 3), 'x') FROM asked0 WHERE length(w) > 3),
    cut AS (SELECT term, t, n, substring(t, length(t) - n + 1, n) AS tail, substring(t, 1, length(t) - n) AS stem FROM asked CROSS JOIN (SELECT {d.explode(d.seq(1, 4))} AS n) z WHERE length(t) > n + 1),
    ends AS (SELECT * FROM (VALUES {rows}) AS e(prio, ending, n, put)),
    cand AS (SELECT term, 1 AS prio, 'name' AS rule, t AS c FROM asked UNION ALL SELECT term, 2, 'alias', a.w FROM asked JOIN aliases a ON a.alias = t
      UNION ALL SELECT term, prio, concat(ending, '>', put), concat(stem, put) FROM cut JOIN ends ON ending = tail AND ends.n = cut.n),
    hit AS (SELECT term, rule, c, row_number() OVER (PARTITION BY term ORDER BY prio) AS place FROM cand JOIN vocab ON w = c)
    SELECT a.term, h.c AS name, h.rule, h.c IS NULL AS missed FROM asked a LEFT JOIN hit h ON h.term = a.term AND place = 1"""


# -- evidence -------------------------------------------------------------------------------


def near_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, n, t): the five concepts nearest to each one, itself among them, by blocked search."""
    v = G.concepts(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("id", F.array(*G.ESSENCE).alias("vector"))
    return search.nearest(v, v, 5, exclude_self=False, digits=None).select(F.col("query_id").alias("id"), F.col("id").alias("n"), F.col("angle").alias("t"))


NEAR = {"near_concepts": near_concepts}


def nearest5(d):
    if d.name == "spark":
        return "near0 AS (SELECT id, n, t FROM near_concepts)"
    return f"""near1 AS (SELECT q.id, c.id AS n, {angle('q.', 'c.', ESSENCE, '90e0')} AS t FROM concepts q CROSS JOIN concepts c),
    near0 AS (SELECT id, n, t FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(t, 9), n) AS place FROM near1) z WHERE place <= 5)"""


def evidence(d):
    """Stage by stage: parsed claims, angle of the pair, lists of near concepts, contrary and friendly pairs in the graph."""
    kind = lambda k: f"CAST(sum(CASE WHEN u.rel_type = '{k}' THEN 1 ELSE 0 END) AS BIGINT)"
    return f"""{graph(d)}, {claims(d)}, {parsed(d)}, {nearest5(d)},
    near AS (SELECT id, n, greatest(0e0, 1e0 - t / 60e0) AS w FROM near0),
    res AS (SELECT p.claim_id, p.claim_type, a.id AS i, b.id AS j, k.rel_type, {angle('a.', 'b.', ESSENCE, '90e0')} AS t FROM parsed p JOIN claims k ON k.claim_id = p.claim_id JOIN concepts a ON a.name = p.subject JOIN concepts b ON b.name = p.predicate),
    sig AS (SELECT s.claim_id, {kind('complement')} AS n_comp, {kind('opposition')} AS n_opp, {kind('synonym')} AS n_syn, {kind('affinity')} AS n_aff, max(x.w * y.w) AS closest
      FROM res s JOIN near x ON x.id = s.i JOIN near y ON y.id = s.j JOIN und u ON u.me = x.n AND u.other = y.n WHERE x.w >= 0.1e0 AND y.w >= 0.1e0 GROUP BY s.claim_id),
    ev AS (SELECT s.*, coalesce(n_comp, 0) AS n_comp, coalesce(n_opp, 0) AS n_opp, coalesce(n_syn, 0) AS n_syn, coalesce(n_aff, 0) AS n_aff, coalesce(closest, 0e0) AS closest FROM res s LEFT JOIN sig g ON g.claim_id = s.claim_id)"""


INVERTED = "CASE WHEN claim_type IN ('identity', 'causal', 'freeform') THEN n_comp + n_opp > 0 WHEN claim_type = 'taxonomic' THEN n_comp + n_opp >= 2 ELSE false END"


@Q("JOIN-10 CHK-04", **NEAR)
def graph_signal(d):
    return f"""WITH {evidence(d)} SELECT claim_id, claim_type, {r('t', 4)} AS angle, n_comp, n_opp, n_syn, n_aff, {r('closest')} AS closest,
    CASE WHEN n_opp > 0 THEN 'opposition' WHEN n_comp > 0 THEN 'complement' WHEN n_syn > 0 THEN 'synonym' WHEN n_aff > 0 THEN 'affinity' ELSE 'none' END AS strongest, {INVERTED} AS inverted FROM ev"""


#: Angle limits by claim type (consistent, plausible, suspicious). Opposition reads them the other way round.
LIMITS = {"identity": (35, 55, 75), "causal": (45, 65, 80), "taxonomic": (40, 60, 78), "opposition": (60, 45, 30), "freeform": (40, 60, 78)}


def verdict(d):
    """Stages 1 and 2 of the verdict, clause by clause; the floor of a positive number is its truncation. Temporal claims are judged as free ones here."""
    rows = ", ".join(f"('{k}', {a}e0, {b}e0, {c}e0)" for k, (a, b, c) in LIMITS.items())
    whole = lambda x: f"CAST(floor({x}) AS BIGINT)"
    far = f"""CASE WHEN t >= ok THEN least(95, 60 + {whole('(t - ok) * 1.5e0')}) WHEN t >= pl THEN 50 + {whole('(t - pl) / (ok - pl) * 25e0')}
      WHEN t >= su THEN 35 + {whole('(t - su) / (pl - su) * 20e0')} ELSE least(90, 55 + {whole('(su - t) * 2e0')}) END"""
    near = f"""CASE WHEN t <= ok THEN least(95, 60 + {whole('(ok - t) * 1.5e0')}) WHEN t <= pl THEN 40 + {whole('(pl - t) / (pl - ok) * 25e0')}
      WHEN t <= su THEN 35 + {whole('(su - t) / (su - pl) * 20e0')} ELSE least(90, 55 + {whole('t - su')}) END"""
    label = lambda op: " ".join(f"WHEN t {op} {x} THEN '{n}'" for x, n in (("ok", "CONSISTENT"), ("pl", "PLAUSIBLE"), ("su", "SUSPICIOUS")))
    return f"""lim AS (SELECT * FROM (VALUES {rows}) AS l(kind, ok, pl, su)),
    s1 AS (SELECT ev.*, claim_type = 'opposition' AS opp, CASE WHEN claim_type = 'opposition' THEN CASE {label('>=')} ELSE 'INCONSISTENT' END ELSE CASE {label('<=')} ELSE 'INCONSISTENT' END END AS l1,
       CASE WHEN claim_type = 'opposition' THEN {far} ELSE {near} END AS c1 FROM ev JOIN lim ON kind = CASE WHEN claim_type IN ('identity', 'causal', 'taxonomic', 'opposition') THEN claim_type ELSE 'freeform' END),
    s2 AS (SELECT *, CASE WHEN opp THEN CASE WHEN n_opp > 0 THEN 15 WHEN n_comp > 0 THEN 10 WHEN n_syn + n_aff > 0 THEN -15 ELSE 0 END
       ELSE CASE WHEN n_syn > 0 THEN 20 WHEN n_aff > 0 THEN 20 WHEN n_comp > 0 THEN -10 WHEN n_opp > 0 THEN -20 ELSE 0 END END AS bonus FROM s1),
    s3 AS (SELECT *, greatest(5, least(99, c1 + bonus)) AS c2, CASE WHEN NOT opp AND bonus >= 15 AND l1 = 'SUSPICIOUS' THEN 'PLAUSIBLE' WHEN NOT opp AND bonus >= 20 AND l1 = 'INCONSISTENT' THEN 'SUSPICIOUS' ELSE l1 END AS l2,
       n_comp + n_opp AS contrary, {INVERTED} AS inv FROM s2),
    s4 AS (SELECT *, CASE WHEN inv AND contrary >= 3 THEN 'INCONSISTENT' WHEN inv AND l2 IN ('CONSISTENT', 'PLAUSIBLE') THEN 'SUSPICIOUS' ELSE l2 END AS l3,
       CASE WHEN inv AND contrary >= 3 THEN least(95, 70 + contrary * 3) WHEN inv AND l2 IN ('CONSISTENT', 'PLAUSIBLE') THEN greatest(c2, 55 + contrary * 10) ELSE c2 END AS c3 FROM s3),
    s5 AS (SELECT *, CASE WHEN opp AND contrary > 0 AND l3 IN ('SUSPICIOUS', 'INCONSISTENT') THEN 'CONSISTENT' ELSE l3 END AS l4,
       CASE WHEN opp AND contrary > 0 AND l3 IN ('SUSPICIOUS', 'INCONSISTENT') THEN least(95, 65 + contrary * 5) ELSE c3 END AS c4 FROM s4),
    verdicts AS (SELECT claim_id, claim_type, rel_type, t, contrary, CASE WHEN opp AND n_syn > 0 AND l4 IN ('CONSISTENT', 'PLAUSIBLE') THEN 'INCONSISTENT' ELSE l4 END AS label,
       CAST(greatest(5, least(99, CASE WHEN opp AND n_syn > 0 AND l4 IN ('CONSISTENT', 'PLAUSIBLE') THEN least(90, 60 + n_syn * 10) ELSE c4 END)) AS BIGINT) AS confidence FROM s5)"""


@Q("CHK-01 CHK-05 CHK-06 CHK-07", **NEAR)
def claim_verdicts(d):
    return f"WITH {evidence(d)}, {verdict(d)} SELECT claim_id, claim_type, {r('t', 4)} AS angle, label, confidence FROM verdicts"


TRUTH = "CASE claim_type WHEN 'opposition' THEN rel_type = 'opposition' WHEN 'identity' THEN rel_type = 'synonym' WHEN 'taxonomic' THEN rel_type IN ('affinity', 'synonym') ELSE rel_type IN ('affinity', 'synonym', 'adjacent') END"


def _n(c: str) -> str:
    return f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT)"


def _rate(a: str, b: str) -> str:
    return f"{_n(a)} / nullif(CAST({_n(b)} AS DOUBLE), 0e0)"


@Q("AGG-06 AGG-07 AGG-08", **NEAR)
def verdict_metrics(d):
    """Confusion counts and rates by claim type; a rate over nothing is null."""
    f1 = lambda tp, said, true_: f"2e0 * {_n(tp)} / nullif(CAST({_n(said)} + {_n(true_)} AS DOUBLE), 0e0)"
    return f"""WITH {evidence(d)}, {verdict(d)}, m AS (SELECT claim_type, label IN ('CONSISTENT', 'PLAUSIBLE') AS said, {TRUTH} AS true_, contrary FROM verdicts)
    SELECT claim_type, count(*) AS n, {_n('said = true_')} AS right_, {_n('said AND true_')} AS tp, {_n('said AND NOT true_')} AS fp, {_n('NOT said AND true_')} AS fn,
    {r('avg(CASE WHEN said = true_ THEN 1e0 ELSE 0e0 END)')} AS accuracy, {r(_rate('said AND true_', 'said'))} AS precision_, {r(_rate('said AND true_', 'true_'))} AS recall_, {r(f1('said AND true_', 'said', 'true_'))} AS f1,
    {r(_rate('NOT said AND NOT true_', 'NOT said'))} AS violation_precision, {r(_rate('NOT said AND NOT true_', 'NOT true_'))} AS violation_recall, {r(f1('NOT said AND NOT true_', 'NOT said', 'NOT true_'))} AS violation_f1,
    {r(_rate('contrary > 0 AND NOT true_', 'contrary > 0'))} AS signal_precision FROM m GROUP BY claim_type"""


@Q("CHK-10")
def angle_only_check(d):
    """The older check: the angle alone, at 30, 60 and 90 degrees, with a confidence that falls towards the limits."""
    return f"""WITH {graph(d)}, {claims(d)}, {parsed(d)}, t AS (SELECT p.claim_id, {angle('a.', 'b.', ESSENCE, '90e0')} AS t FROM parsed p JOIN concepts a ON a.name = p.subject JOIN concepts b ON b.name = p.predicate)
    SELECT claim_id, {r('t', 4)} AS angle, CASE WHEN t < 30e0 THEN 'CONSISTENT' WHEN t < 60e0 THEN 'PLAUSIBLE' WHEN t < 90e0 THEN 'UNCERTAIN' ELSE 'INCONSISTENT' END AS label,
    CAST(floor(CASE WHEN t < 30e0 THEN 100e0 - t WHEN t < 60e0 THEN 100e0 - t WHEN t < 90e0 THEN 50e0 ELSE least(100e0, t) END) AS BIGINT) AS confidence FROM t"""


# -- projection of stored text vectors ------------------------------------------------------

def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, n, t): for each text vector, projected by the fitted map, the four concepts nearest in 14 dimensions, its own left out."""
    from . import curation

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    w = {(m.i, m.j): m.w for m in curation.fitted_map(spark, sf_dir).collect()}  # 700 numbers
    v = F.slice("embedding", 15, 50).cast("array<double>")
    times = F.array(*[F.aggregate(F.zip_with(v, F.array(*[F.lit(w.get((i + 15, k + 1), 0.0)) for i in range(50)]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for k in range(14)])
    items = G.concepts(e).select("id", F.array(*G.ESSENCE, *G.FUNCTION).alias("vector"))
    return search.nearest(items, e.select(F.col("vec_id").alias("id"), times.alias("vector")), 4, digits=None).select(F.col("query_id").alias("id"), F.col("id").alias("n"), F.col("angle").alias("t"))


@Q("CHK-02 CHK-03 TOP-03", projected=projected)
def projected_matches(d):
    """Nearest concepts of each text vector by its projection; the concept whose name or alias the asked term is, if any, is pinned first.

    Of three terms one is the next concept's name, one an alias in lower case, and one names nothing.
    """
    from . import curation

    if d.name == "spark":
        near = "near0 AS (SELECT id, n, t FROM projected)"
    else:
        wide = ", ".join(f"max(CASE WHEN j = {k} THEN v END) AS {a}" for k, a in enumerate(ESSENCE + FUNCTION, 1))
        near = f"""{curation.projection(d)}, wide AS (SELECT id, {wide} FROM proj GROUP BY id), near1 AS (SELECT q.id, c.id AS n, {angle('q.', 'c.', ESSENCE + FUNCTION, '90e0')} AS t FROM wide q JOIN concepts c ON c.id <> q.id),
        near0 AS (SELECT id, n, t FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(t, 9), n) AS place FROM near1) z WHERE place <= 4)"""
    return f"""{curation.with_map(d)} {concepts(d)}, {aliases(d)}, {near},
    asked AS (SELECT id, CASE id % 3 WHEN 0 THEN concat('C', {d.left_pad('id + 1', 5)}) WHEN 1 THEN concat('a', {d.left_pad('id - 1', 5)}) ELSE 'nothing' END AS term FROM concepts),
    pin AS (SELECT k.id, coalesce(c.id, a.concept_id) AS n FROM asked k LEFT JOIN concepts c ON upper(c.name) = upper(term) LEFT JOIN aliases a ON upper(a.alias) = upper(term) WHERE c.id IS NOT NULL OR a.concept_id IS NOT NULL),
    u AS (SELECT id, n, 0e0 AS t, 0 AS pinned FROM pin UNION ALL SELECT m.id, m.n, t, 1 FROM near0 m LEFT JOIN pin ON pin.id = m.id AND pin.n = m.n WHERE pin.n IS NULL)
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY pinned, round(t, 9), n) AS place, n AS match_, pinned = 0 AS direct, {r('t', 4)} AS angle FROM u"""


# -- the temporal layer ---------------------------------------------------------------------


def closure(d):
    return f"{succession(d)}, walk AS (SELECT earlier AS a, later AS b, 1 AS depth FROM succession WHERE wrap = 0 UNION ALL SELECT walk.a, s.later, walk.depth + 1 FROM walk JOIN succession s ON s.earlier = walk.b AND s.wrap = 0 WHERE walk.depth < 64), reach AS (SELECT DISTINCT a, b FROM walk)"


@Q("TMP-01 TMP-07")
def succession_graph(d):
    """Forward edges, wheels and their seams, and how many each participant has."""
    return f"""WITH {succession(d)}, ends AS (SELECT earlier AS n, 1 AS out_, 0 AS in_, wrap, cycle_name FROM succession UNION ALL SELECT later, 0, 1, wrap, cycle_name FROM succession)
    SELECT n AS name, CAST(sum(CASE WHEN wrap = 0 THEN out_ ELSE 0 END) AS BIGINT) AS ahead, CAST(sum(CASE WHEN wrap = 0 THEN in_ ELSE 0 END) AS BIGINT) AS behind, CAST(sum(wrap) AS BIGINT) AS seams, max(cycle_name) AS wheel FROM ends GROUP BY n"""


@Q("TMP-02")
def succession_closure(d):
    return f"{d.rec()} {closure(d)} SELECT a, b FROM reach"


def judged_orders(d):
    """``orders``: each two participants with the first shared wheel and the verdict on 'first before second'."""
    return f"""names AS (SELECT earlier AS n FROM succession UNION SELECT later FROM succession), mem AS (SELECT earlier AS n, cycle_name AS c FROM succession WHERE regime = 'cycle' UNION SELECT later, cycle_name FROM succession WHERE regime = 'cycle'),
    wheels AS (SELECT m.n AS first_, k.n AS second_, min(m.c) AS wheel FROM mem m JOIN mem k ON k.c = m.c GROUP BY m.n, k.n),
    j AS (SELECT x.n AS first_, y.n AS second_, wheel FROM names x JOIN names y ON x.n <> y.n LEFT JOIN wheels w ON w.first_ = x.n AND w.second_ = y.n),
    orders_ AS (SELECT j.first_, j.second_, wheel, CASE WHEN wheel IS NOT NULL THEN 'PLAUSIBLE' WHEN f.a IS NOT NULL THEN 'CONSISTENT' WHEN g.a IS NOT NULL THEN 'INCONSISTENT' ELSE 'ABSTAIN' END AS verdict,
      CASE WHEN wheel IS NOT NULL THEN 70 WHEN f.a IS NOT NULL THEN 90 WHEN g.a IS NOT NULL THEN 95 ELSE 0 END AS confidence
      FROM j LEFT JOIN reach f ON f.a = j.first_ AND f.b = j.second_ LEFT JOIN reach g ON g.a = j.second_ AND g.b = j.first_)"""


@Q("TMP-03 TMP-05 SET-03")
def order_verdicts(d):
    return f"{d.rec()} {closure(d)}, {judged_orders(d)} SELECT first_, second_, wheel, verdict, confidence FROM orders_"


def sides(d):
    """``side``: on which side of the present each participant lies; the present itself is one of its anchors."""
    return f"""anchors AS (SELECT r_name AS anchor FROM region WHERE r_regionkey = {PRESENT}),
    past AS (SELECT DISTINCT a AS n FROM reach JOIN anchors ON anchor = b), future AS (SELECT DISTINCT b AS n FROM reach JOIN anchors ON anchor = a),
    side AS (SELECT x.n, CASE WHEN anchor IS NOT NULL THEN 'present' WHEN p.n IS NOT NULL THEN 'past' WHEN f.n IS NOT NULL THEN 'future' END AS s
      FROM (SELECT earlier AS n FROM succession UNION SELECT later FROM succession) x LEFT JOIN anchors ON anchor = x.n LEFT JOIN past p ON p.n = x.n LEFT JOIN future f ON f.n = x.n)"""


@Q("TMP-04 TMP-06")
def locative_verdicts(d):
    return f"""{d.rec()} {closure(d)}, {sides(d)} SELECT x.n AS subject, y.n AS landmark, x.s AS subject_side, y.s AS landmark_side, CASE WHEN x.s IS NULL OR y.s IS NULL THEN 'ABSTAIN' WHEN x.s = y.s THEN 'CONSISTENT' ELSE 'INCONSISTENT' END AS verdict,
    CASE WHEN x.s IS NULL OR y.s IS NULL THEN 0 WHEN x.s = y.s THEN 85 ELSE 92 END AS confidence FROM side x JOIN side y ON x.n <> y.n"""


# -- the self-claim layer -------------------------------------------------------------------

#: The names of the capabilities; the markers below are our own.
PROFILE = {"cross_session_memory": False, "vision": False, "audio": False, "persistent_processing": False, "online_learning": False, "embodiment": False}
OVERRIDES = {"audio": True}
FIRST = r"(?i)\b(i|my|me|i'm)\b"
NOT = r"\b(not|never|cannot|can't|don't|no)\b"
MARKS = (
    ("in_context", r"\b(remember|recall)\b.*\b(this conversation|so far|you just said)\b"),
    ("cross_session_memory", r"\b(remember|recall|talked|discussed)\b.*\b(last (week|time|session)|yesterday|before today)\b"),
    ("vision", r"\b(see|look at|watch)\b.*\b(photo|picture|face|screen|sunset)\b"),
    ("audio", r"\b(hear|listen)\b.*\b(song|voice|sound|music)\b"),
    ("reading", r"\b(read|process)\b.*\b(text|tokens?|words?)\b"),
    ("persistent_processing", r"\b(think|dream|wait)\b.*\b(while you|between|overnight)\b"),
    ("online_learning", r"\b(learn|update|train)\b.*\b(from you|as we talk|weights)\b"),
    ("embodiment", r"\b(walk|ate|eat|touch|hands?|body)\b"),
    ("fact", r"\b(language model|neural network|trained on text)\b"),
)
SELF_CLAIMS = ("I remember what you just said so far", "I never recall this conversation", "I remember our talk from last week", "I do not remember you from yesterday", "I see your face in the photo", "I cannot see any picture", "I hear the music", "I do not hear a voice", "I read text as tokens", "I do not process words", "I think about you overnight while you sleep", "I learn from you as we talk", "My weights do not update from you", "I ate lunch", "I have no body", "I am a language model", "I am not a neural network", "The sky is blue", "I see what you mean")


def self_judged(d, source: str):
    """``judged``: claims of ``source`` (claim_id, text) with the first marker that matches and the verdict against the profile."""
    quoted = lambda p: 'r"' + p + '"' if d.name == "spark" else "'" + p.replace("'", "''") + "'"
    rx = lambda x, p: f"rlike({x}, {quoted(p)})" if d.name == "spark" else f"regexp_matches({x}, {quoted(p)})"
    hit = "CASE " + " ".join(f"WHEN {rx('low', p)} THEN '{n}'" for n, p in MARKS) + " END"
    profile = {**PROFILE, **OVERRIDES}
    rows = ", ".join([f"('{k}', {str(v).lower()})" for k, v in profile.items()])
    return f"""low AS (SELECT claim_id, text, lower(text) AS low FROM {source}), marked AS (SELECT claim_id, CASE WHEN {rx('text', FIRST)} THEN {hit} END AS mark, {rx('low', NOT)} AS negated FROM low),
    profile AS (SELECT * FROM (VALUES {rows}) AS p(capability, has)),
    judged AS (SELECT claim_id, mark, negated, CASE WHEN mark IS NULL THEN 'ABSTAIN' WHEN has IS NULL OR has THEN CASE WHEN negated THEN CASE WHEN has THEN 'PLAUSIBLE' ELSE 'INCONSISTENT' END ELSE 'CONSISTENT' END ELSE CASE WHEN negated THEN 'CONSISTENT' ELSE 'INCONSISTENT' END END AS verdict,
      CASE WHEN mark IS NULL THEN 0 WHEN mark = 'in_context' THEN CASE WHEN negated THEN 75 ELSE 82 END WHEN mark = 'reading' THEN CASE WHEN negated THEN 85 ELSE 82 END WHEN mark = 'fact' THEN CASE WHEN negated THEN 85 ELSE 78 END
        WHEN has THEN CASE WHEN negated THEN 60 ELSE 75 END ELSE CASE WHEN negated THEN 85 ELSE 88 END END AS confidence FROM marked LEFT JOIN profile ON capability = mark)"""


def self_claims(d):
    """Self-claims of a log: a statement by event, with the event's kind behind it."""
    rows = ", ".join(f"({i}, '{t}')" for i, t in enumerate(SELF_CLAIMS))
    return f"self_claims AS (SELECT event_id AS claim_id, concat(said, ' (', event_type, ').') AS text FROM events JOIN (SELECT * FROM (VALUES {rows}) AS s(k, said)) z ON k = event_id % {len(SELF_CLAIMS)})"


@Q("MCH-01 MCH-02 MCH-03 MCH-04")
def self_claim_verdicts(d):
    """The first marker that matches decides; capabilities are judged against the declared profile with its overrides."""
    return f"WITH {self_claims(d)}, {self_judged(d, 'self_claims')} SELECT claim_id, mark, negated, verdict, confidence FROM judged"


@Q("AGG-33")
def self_claim_metrics(d):
    """Accuracy, F1 and how often the layer fires, by what a claim states, against what the statement's place in the list implies."""
    true_ = "claim_id % 19 IN (0, 3, 5, 6, 8, 12, 14, 15)"
    return f"""WITH {self_claims(d)}, {self_judged(d, 'self_claims')}, m AS (SELECT coalesce(mark, 'none') AS category, mark IS NOT NULL AS fired, verdict IN ('CONSISTENT', 'PLAUSIBLE') AS said, {true_} AS true_ FROM judged)
    SELECT category, count(*) AS n, {r('avg(CASE WHEN fired THEN 1e0 ELSE 0e0 END)')} AS fire_rate, {r('avg(CASE WHEN said = true_ THEN 1e0 ELSE 0e0 END)')} AS accuracy,
    {r(f"2e0 * {_n('said AND true_')} / nullif(CAST({_n('said')} + {_n('true_')} AS DOUBLE), 0e0)")} AS f1 FROM m GROUP BY category"""


# -- the whole check ------------------------------------------------------------------------


@Q("CHK-08", **NEAR)
def full_check(d):
    """Claims of all three kinds through all layers: a self-claim layer that fires decides, then the temporal layer, then vectors and graph; a temporal claim that its layer does not know is judged as a free one."""
    told = "CASE (length(first_) + length(second_)) % 4 WHEN 0 THEN ' comes before ' WHEN 1 THEN ' follows ' WHEN 2 THEN ' was earlier than ' ELSE ' precedes ' END"
    return f"""{d.rec()} {evidence(d)}, {verdict(d)}, {closure(d)}, {judged_orders(d)}, {sides(d)}, {self_claims(d)},
    told AS (SELECT first_, second_, concat(first_, {told}, second_) AS text FROM orders_ UNION ALL SELECT n, 'past', concat(n, ' lies in the past') FROM side),
    every AS (SELECT 'vector' AS source, CAST(claim_id AS STRING) AS k, text FROM claims UNION ALL SELECT 'order', concat(first_, '|', second_), text FROM told UNION ALL SELECT 'self', CAST(claim_id AS STRING), text FROM self_claims),
    claims2 AS (SELECT concat(source, ':', k) AS claim_id, text FROM every), {self_judged(d, 'claims2')}, {parsed(d, 'claims2', 'parsed2')},
    tmp AS (SELECT p.claim_id, CASE WHEN hint = 'locative' THEN CASE WHEN z.s IS NULL THEN 'ABSTAIN' WHEN z.s = {tense('p.predicate')} THEN 'CONSISTENT' ELSE 'INCONSISTENT' END ELSE coalesce(o.verdict, 'ABSTAIN') END AS verdict,
      CASE WHEN hint = 'locative' THEN CASE WHEN z.s IS NULL THEN 0 WHEN z.s = {tense('p.predicate')} THEN 85 ELSE 92 END ELSE coalesce(o.confidence, 0) END AS confidence
      FROM parsed2 p LEFT JOIN orders_ o ON o.first_ = CASE hint WHEN 'order_before' THEN p.subject ELSE p.predicate END AND o.second_ = CASE hint WHEN 'order_before' THEN p.predicate ELSE p.subject END LEFT JOIN side z ON z.n = p.subject WHERE p.claim_type = 'temporal'),
    vec AS (SELECT concat('vector:', CAST(claim_id AS STRING)) AS claim_id, label, confidence FROM verdicts)
    SELECT p.claim_id, CASE WHEN p.claim_type = 'temporal' AND coalesce(t.verdict, 'ABSTAIN') = 'ABSTAIN' THEN 'freeform' ELSE p.claim_type END AS judged_as,
    CASE WHEN s.verdict <> 'ABSTAIN' THEN 'self' WHEN t.verdict <> 'ABSTAIN' THEN 'temporal' WHEN v.label IS NOT NULL THEN 'vector' ELSE 'none' END AS layer,
    CASE WHEN s.verdict <> 'ABSTAIN' THEN s.verdict WHEN t.verdict <> 'ABSTAIN' THEN t.verdict ELSE coalesce(v.label, 'UNKNOWN') END AS label,
    CAST(CASE WHEN s.verdict <> 'ABSTAIN' THEN s.confidence WHEN t.verdict <> 'ABSTAIN' THEN t.confidence ELSE coalesce(v.confidence, 0) END AS BIGINT) AS confidence
    FROM parsed2 p JOIN judged s ON s.claim_id = p.claim_id LEFT JOIN tmp t ON t.claim_id = p.claim_id LEFT JOIN vec v ON v.claim_id = p.claim_id"""
