"""Replies, plans and line grammars: parsers over texts of tables."""

from __future__ import annotations

from ..model import concepts, r
from ..plans.dialect import query

QUERIES: list = []
Q = lambda ids: query(QUERIES, ids)


def share(c: str) -> str:
    return f"avg(CASE WHEN {c} THEN 1e0 ELSE 0e0 END)"


def replies(d):
    """Turns of conversations as replies in eight layouts, with the text that they answer."""
    w = lambda i: f"upper(coalesce({d.at('ws', i)}, 'X'))"
    if d.name == "spark":
        w = lambda i: f"upper(coalesce(get(ws, {i - 1}), 'X'))"
    num = "CAST(length(text) AS STRING)"
    code = "concat(" + ", ' ', ".join(f"CASE (length(text) + {7 * i} + turn) % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'M' ELSE 'H' END" for i in range(14)) + ")"
    layouts = [
        f"concat('PAIR: ', {w(1)}, ' + ', {w(2)})",
        f"concat('SINGLE: ', {w(2)})",
        "CASE WHEN turn % 2 = 0 THEN 'NONE' ELSE concat('NONE of these. CODE: ', code) END",
        "text",
        f"concat('ANSWER: 7 CONFIDENCE: 20', chr(10), 'ANSWER: 1,', {num}, ' CONFIDENCE: ', CAST(40 + length(text) % 90 AS STRING))",
        f"concat('{{\"a\": 1}} so {{\"choice\": \"', lower({w(1)}), '\", \"p\": ', {num}, '}} or {{\"choice\": \"x\"}} and {{\"choice\": ')",
        "concat('CODE: ', code)",
        f"concat('**', {w(1)}, '** and _', {w(2)}, '_', chr(10), '```', chr(10), 'x = ', {num}, chr(10), '```', chr(10), '# ', text)",
    ]
    arms = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(layouts))
    return f"""turns AS (SELECT conv_id, turn, role, text, {d.rall('text', '[A-Za-z]+')} AS ws, {code} AS code, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations),
    replies AS (SELECT conv_id, turn, role, asked, text, code, (conv_id + turn) % 8 AS layout, CASE (conv_id + turn) % 8 {arms} END AS t FROM turns)"""


@Q("TXT-08")
def pair_replies(d):
    """PAIR, SINGLE, NONE or INVALID, and the names."""
    return f"""WITH {replies(d)} SELECT conv_id, turn, CASE WHEN {d.rx('t', '^NONE[.]?$')} THEN 'NONE' WHEN {d.rx('t', '^PAIR: *[A-Z]+ *[+] *[A-Z]+$')} THEN CASE WHEN {d.rg('t', '^PAIR: *([A-Z]+)', 1)} = {d.rg('t', '[+] *([A-Z]+)$', 1)} THEN 'INVALID' ELSE 'PAIR' END WHEN {d.rx('t', '^SINGLE: *[A-Z]+$')} THEN 'SINGLE' ELSE 'INVALID' END AS kind,
    {d.rg('t', '^(?:PAIR|SINGLE): *([A-Z]+)', 1)} AS first_, {d.rg('t', '^PAIR: *[A-Z]+ *[+] *([A-Z]+)$', 1)} AS second_ FROM replies"""


@Q("TXT-07")
def first_named(d):
    """Of a list of names the one that a reply mentions first; the longer name wins at one place."""
    return f"""WITH {replies(d)}, names AS (SELECT DISTINCT lower(substring(p_type, 1, 4)) AS name FROM part UNION SELECT DISTINCT lower(w) FROM (SELECT {d.explode(d.rall('text', '[A-Za-z]{5}'))} AS w FROM benchmark) z),
    tok AS (SELECT conv_id, turn, {d.explode(d.seq(1, 'greatest(1, length(t) - 3)'))} AS i, lower(t) AS t FROM replies), m AS (SELECT conv_id, turn, i, name, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i, length(name) DESC, name) AS place
      FROM (SELECT conv_id, turn, i, substring(t, i, n) AS cand FROM tok CROSS JOIN (SELECT {d.explode(d.seq(4, 5))} AS n) z) c JOIN names ON name = cand)
    SELECT p.conv_id, p.turn, coalesce(upper(m.name), 'NONE') AS named, CAST(m.i AS BIGINT) AS at_ FROM replies p LEFT JOIN m ON m.conv_id = p.conv_id AND m.turn = p.turn AND place = 1"""


@Q("TXT-09")
def code_replies(d):
    """A code of fourteen fields, if the reply does not begin with NONE; NONE comes first."""
    found = d.rg("t", "CODE: ((?:[LMH] ){13}[LMH])$", 1)
    return f"""WITH {replies(d)}, c AS (SELECT conv_id, turn, code, CASE WHEN {d.rx('t', '^NONE')} THEN 'NONE' WHEN {found} = '' THEN 'INVALID' ELSE {d.rr(found, ' ', '')} END AS parsed FROM replies)
    SELECT conv_id, turn, parsed, parsed = {d.rr('code', ' ', '')} AS right_, CASE WHEN length(parsed) = 14 THEN length({d.rr('parsed', 'M', '')}) END AS dense FROM c"""


@Q("TXT-12 TXT-17 AGG-48")
def answer_confidence(d):
    """The last answer and confidence of a reply, thousands separators out, the confidence held between 50 and 100; else the first number anywhere."""
    last = lambda p: f"coalesce({d.last(d.rall('t', p))}, '')"
    num = f"coalesce(nullif({d.rr(d.rr(last('ANSWER: *[0-9,]+'), '^ANSWER: *', ''), ',', '')}, ''), nullif({d.rr(d.rg('t', '([0-9][0-9,]*[.]?[0-9]*)', 1), '[,]', '')}, ''))"
    sure = d.rr(last("CONFIDENCE: *[0-9]+"), "^CONFIDENCE: *", "")
    return f"""WITH {replies(d)}, n AS (SELECT conv_id, turn, layout, {d.try_double(num)} AS answer, CAST({d.try_double(f"nullif({sure}, '')")} AS BIGINT) AS said FROM replies), k AS (SELECT conv_id, sum(CASE WHEN answer IS NOT NULL THEN 1 ELSE 0 END) AS valid FROM n GROUP BY conv_id)
    SELECT n.conv_id, turn, {r('answer', 3)} AS answer, CASE WHEN said IS NOT NULL THEN greatest(50, least(100, said)) END AS confidence, CAST(valid AS BIGINT) AS valid, CASE WHEN valid >= 2 THEN 'numeric' ELSE 'text' END AS route FROM n JOIN k ON k.conv_id = n.conv_id"""


@Q("TXT-13")
def last_json(d):
    """The last complete object of a reply that has both required keys."""
    objects = d.rall("t", "[{][^{}]*[}]")
    ok = d.keep(objects, "o", f"{d.json('o', 'choice')} IS NOT NULL AND {d.json('o', 'p')} IS NOT NULL")
    return f"""WITH {replies(d)}, j AS (SELECT conv_id, turn, {d.size(objects)} AS objects, {d.last(ok)} AS o FROM replies WHERE layout = 5)
    SELECT conv_id, turn, CAST(objects AS BIGINT) AS objects, o AS json, {d.json('o', 'choice')} AS choice, CAST({d.json('o', 'p')} AS BIGINT) AS p FROM j"""


@Q("TXT-15")
def literal_leaks(d):
    """Whether a reply repeats a word of four letters or a run of three digits of the text it answers."""
    words = lambda x: d.distinct(d.rall(f"lower({x})", "[a-z]{4,}"))
    runs = lambda x: d.distinct(d.rall(d.rr(x, "[, ]", ""), "[0-9]{3,}"))
    return f"""WITH {replies(d)}, f AS (SELECT conv_id, turn, role, {d.overlap(words('t'), words('asked'))} AS by_word, {d.overlap(runs('t'), runs('asked'))} AS by_digits FROM replies WHERE asked IS NOT NULL), m AS (SELECT role, {r(share('by_word OR by_digits'))} AS role_share FROM f GROUP BY role)
    SELECT conv_id, turn, by_word, by_digits, by_word OR by_digits AS leaked, role_share FROM f JOIN m ON m.role = f.role"""


@Q("TXT-16")
def fences_and_marks(d):
    """Code between fences, the text beside it, and emphasis taken off."""
    parts = d.split("t", "```")
    return f"""WITH {replies(d)}, p AS (SELECT conv_id, turn, t, {parts} AS parts FROM replies), q AS (SELECT conv_id, turn, parts, {d.size('parts')} AS n, {d.rr('t', '(?s)```.*?```', ' ')} AS outside FROM p)
    SELECT conv_id, turn, CAST(floor((n - 1) / 2) AS BIGINT) AS fences, CASE WHEN n >= 3 THEN trim({d.at('parts', 2)}) END AS code, CAST(length({d.rr(d.rr('outside', '[*][*]([^*]+)[*][*]', BACK(d)), '_([^_]+)_', BACK(d))}) AS BIGINT) AS plain_chars,
    {d.rr(d.rg('outside', '[*][*]([^*]+)[*][*]', 1), '[0-9]', '#')} AS strong, (n - 1) % 2 = 1 AS open_ FROM q"""


def BACK(d):
    return "$1" if d.name == "spark" else "\\1"


@Q("TXT-11 TXT-14 AGG-19 AGG-20")
def text_shape(d):
    """Visible mass, size, words and digit runs of turns by role."""
    mass = f"length({d.rr(d.rr('text', '[*_#>|~-]+', ''), '[ ]+', '')})"
    return f"""SELECT role, count(*) AS n, {r('avg(length(text))')} AS chars, {r(f"avg(length(text) - length({d.rr('text', chr(10), '')}) + 1)")} AS lines_, {r(f'avg({mass})')} AS mass,
    {r(share(d.rx('text', '[.!?]')))} AS with_sentence, {r(share(f"NOT {d.rx('text', '[!]\\[')}"))} AS no_image, {r(share(d.rx('lower(text)', '(cannot|not able|unable)')))} AS deflects, {r(f"avg({d.size(d.rall('lower(text)', '[a-z]{4,}'))})")} AS long_words,
    {r(f"avg({d.size(d.rall(d.rr('text', '[,.]', ''), '[0-9]{3,}'))})")} AS digit_runs FROM conversations GROUP BY role"""


@Q("AGG-39")
def thought_channel(d):
    """Share of replies with a thought (their fenced part), its mean length, and how often it mentions the answer."""
    return f"""WITH {replies(d)}, p AS (SELECT role, t, CASE WHEN {d.rx('t', '```')} THEN {d.at(d.split('t', '```'), 2)} END AS thought, CAST(length(text) AS STRING) AS answer FROM replies)
    SELECT role, count(*) AS n, {r(share('thought IS NOT NULL'))} AS share, {r('avg(length(thought))')} AS chars, {r('avg(CASE WHEN thought IS NULL THEN NULL WHEN position(answer IN thought) > 0 THEN 1e0 ELSE 0e0 END)')} AS mentions FROM p GROUP BY role"""


@Q("TXT-18")
def state_round_trip(d):
    """A state rendered as text and read back: the same fields."""
    keys = ("x", "y", "z", "e", "f", "g", "h")
    text = "concat(name, ' @ ', CAST(level AS STRING)" + "".join(f", ' | {k}=', CAST(CAST(round({k} * 1000) AS BIGINT) AS STRING)" for k in keys) + ")"
    back = ", ".join(f"CAST({d.rg('t', f'{k}=(-?[0-9]+)', 1)} AS BIGINT) AS {k}" for k in keys)
    same = " AND ".join(f"b.{k} = CAST(round(c.{k} * 1000) AS BIGINT)" for k in keys)
    return f"""WITH {concepts(d)}, s AS (SELECT id, {text} AS t FROM concepts), b AS (SELECT id, t, {d.rg('t', '^([A-Z0-9]+) @', 1)} AS name, CAST({d.rg('t', '@ ([0-9]+)', 1)} AS BIGINT) AS level, {back} FROM s)
    SELECT b.id, b.name, b.level, {', '.join('b.' + k for k in keys)}, b.name = c.name AND b.level = c.level AND {same} AS same FROM b JOIN concepts c ON c.id = b.id"""


@Q("TXT-19 HSH-01 STR-12 STR-06 JOIN-18")
def trial_plan(d):
    """A plan as the product of items, repeats and arms, option order rotated, each call hashed, its id parsed back; the plan's own hash over ordered lines."""
    part = lambda i: d.at(d.split("call_id", "-"), i)
    return f"""WITH a AS (SELECT p_partkey AS item FROM part), b AS (SELECT {d.explode(d.seq(0, 3))} AS rep), s AS (SELECT s_suppkey % 3 AS arm FROM supplier GROUP BY s_suppkey % 3),
    p AS (SELECT item, rep, arm, (item + rep) % 4 AS first_option, concat('c-', CAST(item AS STRING), '-', CAST(rep AS STRING), '-', CAST(arm AS STRING)) AS call_id FROM a CROSS JOIN b CROSS JOIN s),
    h AS (SELECT *, {d.sha("concat(call_id, '|', CAST(first_option AS STRING))")} AS body FROM p), t AS (SELECT item, {d.sha(d.join("concat(call_id, ' ', body)", ';', "concat(call_id, ' ', body)"))} AS plan FROM h GROUP BY item)
    SELECT call_id, CAST({part(2)} AS BIGINT) AS item, CAST({part(3)} AS BIGINT) AS rep, CAST({part(4)} AS BIGINT) AS arm, CAST(first_option AS BIGINT) AS first_option, body, plan, {d.hash("concat('seed|', call_id)")} AS seed FROM h JOIN t ON t.item = h.item"""


@Q("JSN-02")
def rounded_report(d):
    """Numbers of a report at three significant digits; what is no number becomes null."""
    sig = lambda x: f"CASE WHEN {x} = 0e0 THEN 0e0 WHEN {x} IS NULL OR isnan({x}) OR abs({x}) > 1e300 THEN NULL ELSE round({x} / power(10e0, floor(log10(abs({x}))) - 2e0), 0) * power(10e0, floor(log10(abs({x}))) - 2e0) END"
    return f"""WITH t AS (SELECT l_returnflag AS flag, l_linestatus AS status, avg(l_extendedprice) AS price, avg(l_discount) AS discount, CASE WHEN l_linestatus = 'F' THEN CAST('NaN' AS DOUBLE) ELSE avg(l_tax) END AS tax FROM lineitem GROUP BY l_returnflag, l_linestatus)
    SELECT flag, status, {r(sig('price'), 2)} AS price, {r(sig('discount'), 6)} AS discount, {r(sig('tax'), 6)} AS tax FROM t"""


def _lines(d):
    """Lines of three grammars, comments, blanks and noise, drawn from a table."""
    k = "CAST(p_partkey AS STRING)"
    return f"""lines AS (SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN concat('N', {k}, ' | ', p_name, ' | ', CASE WHEN p_size % 2 = 0 THEN 'kan' ELSE 'LI' END) WHEN 1 THEN concat('N', {k}, ' | ', p_name) WHEN 2 THEN concat('# ', p_name) WHEN 3 THEN ''
      WHEN 4 THEN concat('REL a', {k}, ' b', {k}, ' OPP ', CAST(p_size AS STRING)) WHEN 5 THEN concat('POL a', {k}, ' NEG') WHEN 6 THEN concat('REG a', {k}, ' ', upper(substring(p_type, 1, 3))) ELSE p_name END AS t FROM part)"""


@Q("SRC-07 SRC-13")
def line_grammars(d):
    """Entries, ratings and labels by their grammar; comments and blanks are skipped, the rest is dropped and counted."""
    part = lambda i: f"nullif(trim({d.rg('t', '^([^|]*)[|]?([^|]*)[|]?([^|]*)$', i)}), '')"
    kind = f"CASE WHEN t = '' OR {d.rx('t', '^#')} THEN 'skip' WHEN {d.rx('t', '^REL [^ ]+ [^ ]+ [A-Z]+')} THEN 'rel' WHEN {d.rx('t', '^(POL|REG) [^ ]+ [A-Z]+$')} THEN lower(substring(t, 1, 3)) WHEN {d.rx('t', '[|]')} THEN 'entry' ELSE 'dropped' END"
    return f"""WITH {_lines(d)}, k AS (SELECT id, t, {kind} AS kind FROM lines), n AS (SELECT sum(CASE WHEN kind = 'dropped' THEN 1 ELSE 0 END) AS dropped FROM k)
    SELECT id, kind, CASE WHEN kind = 'entry' THEN {part(1)} END AS name, CASE WHEN kind = 'entry' THEN coalesce({part(2)}, '') END AS description, CASE WHEN kind = 'entry' THEN upper(coalesce({part(3)}, 'QIAN')) END AS class,
    CASE WHEN kind = 'rel' THEN {d.rg('t', '^REL [^ ]+ [^ ]+ ([A-Z]+)', 1)} WHEN kind IN ('pol', 'reg') THEN {d.rg('t', '([A-Z]+)$', 1)} END AS label, {d.try_double(f"nullif({d.rg('t', ' ([0-9]+)$', 1)}, '')")} AS degrees, CAST(dropped AS BIGINT) AS dropped FROM k CROSS JOIN n"""


@Q("SRC-14")
def list_layouts(d):
    """Two layouts of a list in one text: bold names inline, or numbered names with fields below."""
    item = lambda c, i: f"CASE WHEN {c} THEN concat('**', {i}, '** - ', p_type, '; ', p_brand) ELSE concat(CAST(p_partkey AS STRING), '. ', {i}, chr(10), 'fields: ', p_type, '; ', p_brand) END"
    text = d.join(item("p_size % 2 = 0", "p_name"), "@", "p_partkey")
    return f"""WITH s AS (SELECT p_brand AS source, {text} AS t FROM part GROUP BY p_brand), e AS (SELECT source, {d.explode(d.split('t', '@'))} AS e FROM s)
    SELECT source, CASE WHEN {d.rx('e', '^[*][*]')} THEN 'inline' ELSE 'block' END AS layout, trim(CASE WHEN {d.rx('e', '^[*][*]')} THEN {d.rg('e', '^[*][*]([^*]+)[*][*]', 1)} ELSE {d.rg('e', '^[0-9]+[.] ([^' + chr(10) + ']+)', 1)} END) AS name,
    count(*) AS n, min(trim({d.rg('e', '(?:- |fields: )([^;]+);', 1)})) AS first_field, max(trim({d.rg('e', ';([^;]+)$', 1)})) AS last_field FROM e GROUP BY source, CASE WHEN {d.rx('e', '^[*][*]')} THEN 'inline' ELSE 'block' END,
    trim(CASE WHEN {d.rx('e', '^[*][*]')} THEN {d.rg('e', '^[*][*]([^*]+)[*][*]', 1)} ELSE {d.rg('e', '^[0-9]+[.] ([^' + chr(10) + ']+)', 1)} END)"""


@Q("STR-08 STR-10 AGG-34")
def response_checks(d):
    """A probability answer by key: keys, range and sum checked, the choice among the keys; type score, mass and door; long bodies go by their hash."""
    keys = ("a", "b", "c", "d")
    k = f"CAST({d.json('props', 'k')} AS BIGINT)"
    p = {x: f"({k} + {i * 7}) % {9 + i} / 16e0" for i, x in enumerate(keys)}
    body = "concat('{\"text\": \"t', CAST(event_id AS STRING), '\", \"choice\": \"', choice, '\", ' " + "".join(f", '\"{x}\": ', CAST(p_{x} AS STRING), '{', ' if x != 'd' else '}'}'" for x in keys) + ")"
    raw = lambda x: d.try_double(d.json("body", x))
    return f"""WITH e AS (SELECT event_id, event_type, substring('abcdx', CAST(event_id % 5 AS INT) + 1, 1) AS choice, {', '.join(f'{v} AS p_{x}' for x, v in p.items())} FROM events), b AS (SELECT event_id, {body} AS body FROM e),
    v AS (SELECT event_id, body, {d.json('body', 'text')} AS text, {d.json('body', 'choice')} AS choice, {', '.join(f'{raw(x)} AS {x}' for x in keys)} FROM b), s AS (SELECT *, a + b + c + d AS total FROM v)
    SELECT event_id, text, choice, choice IN ('a', 'b', 'c', 'd') AS known, {r('total')} AS total, a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL AS numeric_, total BETWEEN 0.97e0 AND 1.03e0 AS sums,
    {r('a + b - c - d')} AS type_score, {r('total')} AS mass, {r('greatest(a, b, c, d) - total / 4e0')} AS door, {d.sha('body')} AS blob FROM s"""


@Q("STR-09")
def response_costs(d):
    return f"SELECT event_id, {d.json('props', 'nope')} IS NULL AS lacks_key, coalesce({d.try_double(d.json('props', 'cost'))}, 0e0) AS cost, {r(f'coalesce({d.try_double(d.json('props', 'k'))}, 0e0) * 0.001e0')} AS charge FROM events"
