"""SQL of the retrieval queries, written operator at a time over the same tables.

Trees are turned into one common table expression per node: positional operators as recursive pointer
loops, scored operators as joins and unions of complete result lists, defaults as lists over all documents.
"""

from __future__ import annotations

from siftlight.functions.analysis import STOPWORDS
from siftlight.operators.letor import FEATURES, TEXT_FIELDS
from siftlight.plans import models as M
from siftlight.plans import tree as T
from siftlight.plans.parser import parse
from siftlight.plans.rules import analyze
from siftlight import retrieval_queries as Q

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_LINK = r"\[([^\]\n]*)\]\(([^)\s]+)\)"
_WORD = r"[\p{L}\p{M}\p{N}]+(?:[''’][\p{L}\p{M}\p{N}]+)*"


def _tokens(text: str) -> str:
    spaced = rf"regexp_replace(lower(coalesce({text}, '')), '([\p{{Han}}\p{{Hiragana}}\p{{Katakana}}])', ' \1 ', 'g')"
    return f"list_transform(regexp_extract_all({spaced}, '{_WORD}'), lambda w: regexp_replace(w, '[''’]s$', ''))"


def _key(url: str) -> str:
    return f"regexp_replace(regexp_replace(lower({url}), '^https?://', ''), '/$', '')"


_BASE = rf"""
rec as (
  select * from doc_store where doc_id is not null
  qualify row_number() over (partition by doc_id order by indexed_at desc nulls last, raw_url desc nulls last,
    spam_score desc nulls last, deleted_at desc nulls last) = 1),
page as (
  select d.doc_id, lower(trim(d.ext_id)) as ext_id, r.raw_url, r.spam_score, r.deleted_at, d.text, d.title
  from documents d left join rec r using (doc_id)),
link as (
  select doc_id, unnest(regexp_extract_all(text, '{_LINK}', 1)) as anchor, unnest(regexp_extract_all(text, '{_LINK}', 2)) as address,
         unnest(range(len(regexp_extract_all(text, '{_LINK}', 1)))) as pos
  from documents where contains(text, '](')),
own as (select doc_id, string_agg(anchor, ' ' order by pos) as t from link group by 1),
led as (
  select r.doc_id, l.t from rec r join (
    select {_key("address")} as k, string_agg(anchor, ' ' order by doc_id, pos) as t from link group by 1) l
  on l.k = {_key("r.raw_url")}),
txt as (
  select doc_id, 'body' as field, text as t from page union all select doc_id, 'title', title from page
  union all select doc_id, 'url', raw_url from page
  union all select doc_id, 'keywords', t from own union all select doc_id, 'inlink', t from led where doc_id in (select doc_id from page)),
tok as (select doc_id, field, {_tokens("t")} as l from txt),
post as (
  select * from (select doc_id, field, unnest(l) as term, unnest(range(len(l))) as pos from tok)
  where term <> '' and term not in ({_STOP})),
dl as (select doc_id, field, count(*) as len from post group by all),
fs as (select field, count(*) as doc_count, sum(len) as sum_ttf, sum(len) / count(*) as average from dl group by all),
ts as (select field, term, count(distinct doc_id) as df, count(*) as ctf from post group by all),
n as (select count(*) as n from documents)"""


class _Tree:
    def __init__(self, model: M.Model):
        self.model, self.parts, self.names = model, [], {}

    def add(self, name: str, sql: str) -> str:
        self.parts.append(f"{name} as ({sql})")
        return name

    def leaf(self, x: T.ListNode) -> str:
        if x in self.names:
            return self.names[x]
        if isinstance(x, T.Term):
            sql = f"select doc_id, list(pos order by pos) as p from post where term = '{x.term}' and field = '{x.field}' group by 1"
            name = self.add(f"l{len(self.names)}", sql)
        else:
            args = [self.leaf(a) for a in x.children()]
            name = f"l{len(self.names)}"
            if isinstance(x, T.Syn):
                each = " union all ".join(f"select doc_id, unnest(p) as q from {a}" for a in args)
                self.add(name, f"select doc_id, list(q order by q) as p from ({each}) group by 1")
            elif isinstance(x, T.Near):
                for k, b in enumerate(args[1:]):
                    a = args[0] if k == 0 else f"{name}_{k - 1}"
                    loop = f"{name}_r{k}"
                    self.add(f"{loop}(doc_id, a, b, i, j, o)", f"""
  select a.doc_id, a.p, b.p, 1, 1, cast([] as bigint[]) from {a} a join {b} b using (doc_id)
  union all
  select doc_id, a, b, case when b[j] < a[i] then i else i + 1 end,
         case when b[j] - a[i] > {x.n} then j else j + 1 end,
         case when b[j] >= a[i] and b[j] - a[i] <= {x.n} then list_append(o, b[j]) else o end
  from {loop} where i <= len(a) and j <= len(b)""")
                    last = k == len(args) - 2
                    self.add(name if last else f"{name}_{k}", f"select doc_id, o as p from {loop} where (i > len(a) or j > len(b)) and len(o) > 0")
            else:
                ks = range(len(args))
                joins = f"{args[0]} a0 " + " ".join(f"join {args[k]} a{k} using (doc_id)" for k in ks[1:])
                now = "[" + ", ".join(f"a{k}[i{k}]" for k in ks) + "]"
                hit = f"list_max({now}) - list_min({now}) <= {x.n - 1}"
                cols = ", ".join([*(f"a{k}" for k in ks), *(f"i{k}" for k in ks)])
                live = " and ".join(f"i{k} <= len(a{k})" for k in ks)
                move = ", ".join(f"i{k} + (case when {hit} or list_position({now}, list_min({now})) = {k + 1} then 1 else 0 end)" for k in ks)
                self.add(f"{name}_r(doc_id, {cols}, o)", f"""
  select doc_id, {", ".join(f"a{k}.p" for k in ks)}, {", ".join("1" for _ in ks)}, cast([] as bigint[]) from {joins}
  union all
  select doc_id, {", ".join(f"a{k}" for k in ks)}, {move}, case when {hit} then list_append(o, list_max({now})) else o end
  from {name}_r where {live}""")
                self.add(name, f"select doc_id, o as p from {name}_r where not ({live}) and len(o) > 0")
        self.names[x] = name
        return name

    def node(self, x: T.Node, path: str = "x") -> str:
        """A CTE (doc_id, s) of the node's result; with Indri also d_<name> of its default for every document."""
        m, name = self.model, f"n_{path}"
        if isinstance(x, T.Score):
            leaf, f = self.leaf(x.list), x.list.field
            self.add(f"c_{path}", f"select count(*)::double as df, coalesce(sum(len(p)), 0)::double as ctf from {leaf}")
            src = (
                f"(select d.doc_id, l.p, coalesce(len(l.p), 0)::double as tf, coalesce(dl.len, 0)::double as len, "
                f"coalesce((select sum_ttf from fs where field = '{f}'), 0)::double as total, coalesce((select average from fs where field = '{f}'), 1)::double as avg "
                f"from documents d left join {leaf} l using (doc_id) left join (select * from dl where field = '{f}') dl using (doc_id))"
            )
            if isinstance(m, M.Indri):
                p = "(case when total > 0 then ctf / total else 0 end)"
                s = f"{m.lam} * (tf + {m.mu} * {p}) / (len + {m.mu}) + {1 - m.lam} * {p}"
                self.add(f"d_{path}", f"select doc_id, p, {s} as s from {src}, c_{path}")
                return self.add(name, f"select doc_id, s from d_{path} where p is not null")
            if isinstance(m, M.BM25):
                s = f"ln(((select n from n) - df + 0.5) / (df + 0.5)) * tf / (tf + {m.k1} * ({1 - m.b} + {m.b} * len / avg))"
            else:
                s = "tf" if isinstance(m, M.RankedBoolean) else "1.0::double"
            return self.add(name, f"select doc_id, {s} as s from {src}, c_{path} where p is not null")
        kids = [self.node(a, f"{path}{i}") for i, a in enumerate(x.children())]
        every = " union all ".join(f"select doc_id, s from {k}" for k in kids)
        if isinstance(m, M.Indri):
            w = x.weights if isinstance(x, T.Weighted) else [1 / len(kids)] * len(kids)
            joins = "documents d " + " ".join(f"join d_{k[2:]} k{i} using (doc_id)" for i, k in enumerate(kids))
            if isinstance(x, T.WSum):
                s = " + ".join(f"{wi} * k{i}.s" for i, wi in enumerate(w))
            else:
                s = " * ".join(f"pow(k{i}.s, {wi})" for i, wi in enumerate(w))
            self.add(f"d_{path}", f"select doc_id, {s} as s from {joins}")
            return self.add(name, f"select doc_id, s from d_{path} where doc_id in (select doc_id from ({every}))")
        if isinstance(x, T.And):
            return self.add(name, f"select doc_id, min(s) as s from ({every}) group by 1 having count(*) = {len(kids)}")
        how = "sum" if isinstance(x, T.Sum) else "max"
        return self.add(name, f"select doc_id, {how}(s) as s from ({every}) group by 1")


def tree_sql(node: T.Node, model: M.Model, final: str) -> str:
    """``final`` selects from result(doc_id, s)."""
    tree = analyze(node, model)
    if isinstance(tree, T.Score):
        tree = analyze(model.default((node,)), model)
    made = _Tree(model)
    top = made.node(tree)
    return f"with recursive {_BASE},\n" + ",\n".join(made.parts) + f",\nresult as (select * from {top})\n{final}"


def _with(sql: str) -> str:
    return f"with {_BASE}\n{sql}"


_LATEST = "select qid, query from (select *, row_number() over (partition by qid order by ord desc, query desc nulls last) as k from queries where qid is not null) where k = 1"

_FILE_RUNS = """
line as (
  select run_id, qid, item as ext_id, score,
         row_number() over (partition by run_id, qid order by rank_no nulls last, score desc, item nulls first) as k
  from (select *, nullif(lower(trim(ext_id)), '') as item from runs) where score is not null and not isnan(score))"""


def _prf(final: str) -> str:
    """Feedback terms: every candidate term against every feedback document."""
    node = parse(Q.FB_QUERY, Q.INDRI)
    tree = analyze(node, Q.INDRI)
    made = _Tree(Q.INDRI)
    top = made.node(tree)
    more = f"""
fb as (select doc_id, round(s, 12) as score from {top} join page using (doc_id) order by round(s, 12) desc, ext_id limit {Q.FB_DOCS}),
cand as (select distinct term from post join fb using (doc_id) where field = 'body' and not regexp_matches(term, '^.+[.,]')),
tfs as (select doc_id, term, count(*) as tf from post where field = 'body' group by all),
pt as (select term, ctf / (select sum_ttf from fs where field = 'body') as p from ts where field = 'body'),
learned as (
  select term, round(sum((coalesce(tf, 0) + {Q.FB_MU} * p) / (coalesce(len, 0) + {Q.FB_MU}) * fb.score * ln(1 / p)), 12) as score
  from cand join pt using (term) cross join fb left join tfs using (doc_id, term)
  left join (select * from dl where field = 'body') dl using (doc_id) group by term),
best as (select *, row_number() over (order by score desc, term) as rank from learned qualify rank <= {Q.FB_TERMS})"""
    return f"with recursive {_BASE},\n" + ",\n".join(made.parts) + "," + more + final


def _letor() -> str:
    m = Q.LETOR
    per = f"""
select pair.qid, pair.doc_id, f.field,
  case when dl.len is not null then coalesce(sum(ln((n.n - ts.df + 0.5) / (ts.df + 0.5)) * x.tf / (x.tf + {m.k1} * ({1 - m.b} + {m.b} * dl.len / fs.average))
    * ({m.k3} + 1) * b.qtf / ({m.k3} + b.qtf)), 0) end as bm25,
  case when dl.len is not null then case when count(x.tf) = 0 then 0 when sum(case when ts.ctf is null then 1 else 0 end) > 0 then 0
    else exp(sum(b.qtf * ln({m.lam} * (coalesce(x.tf, 0) + {m.mu} * ts.ctf / fs.sum_ttf) / (dl.len + {m.mu}) + {1 - m.lam} * ts.ctf / fs.sum_ttf)) / any_value(b.qlen)) end end as indri,
  case when dl.len is not null then coalesce(sum(case when x.tf is not null then b.qtf end), 0) / any_value(b.qlen) end as overlap,
  case when count(x.tf) > 0 then 1 else 0 end as any_term
from pair cross join (select unnest({list(TEXT_FIELDS)}) as field) f cross join n
join bag b on b.qid = pair.qid
left join fs on fs.field = f.field
left join ts on ts.field = f.field and ts.term = b.term
left join tfs x on x.doc_id = pair.doc_id and x.field = f.field and x.term = b.term
left join dl on dl.doc_id = pair.doc_id and dl.field = f.field
group by pair.qid, pair.doc_id, f.field, dl.len"""
    cols = {}
    i = 5
    for f in TEXT_FIELDS:
        for name in ("bm25", "indri", "overlap"):
            cols[f"f{i}"] = f"max(case when field = '{f}' then {name} end)"
            i += 1
    wide = ", ".join(f"{v} as {k}" for k, v in cols.items())
    return _with(f""",
q as ({_LATEST}),
word as (select qid, unnest({_tokens("query")}) as term from q where query is not null),
bag0 as (select qid, term, count(*) as qtf from word where term <> '' and term not in ({_STOP}) group by all),
bag as (select *, sum(qtf) over (partition by qid) as qlen from bag0),
jd as (
  select qid, lower(trim(ext_id)) as ext_id, greatest(coalesce(rel, 0), 0) as rel, judged_at from qrels where qid is not null and trim(ext_id) <> ''
  qualify row_number() over (partition by qid, lower(trim(ext_id)) order by judged_at desc nulls last, greatest(coalesce(rel, 0), 0) desc) = 1),
pr as (
  select lower(trim(ext_id)) as ext_id, pagerank from pagerank where trim(ext_id) <> '' and pagerank is not null and not isnan(pagerank)
  qualify row_number() over (partition by lower(trim(ext_id)) order by computed_at desc nulls last, pagerank desc) = 1),
pair as (select jd.qid, jd.ext_id, jd.rel, page.doc_id, page.spam_score, page.raw_url from jd join page using (ext_id)
         where jd.qid in (select qid from bag)),
tfs as (select doc_id, field, term, count(*) as tf from post group by all),
per as ({per}),
wide as (select qid, doc_id, {wide}, sum(any_term) as any_n from per group by 1, 2)
select pair.qid, pair.ext_id, pair.rel, round(spam_score::double, 12) as f1,
  round(length(coalesce(raw_url, '')) - length(replace(coalesce(raw_url, ''), '/', '')), 12)::double as f2,
  case when contains(lower(raw_url), 'wikipedia.org') then 1.0 else 0.0 end::double as f3, round(pagerank, 12) as f4,
  {", ".join(f"round(f{k}, 12) as f{k}" for k in range(5, 17))},
  case when contains(raw_url, '.edu') or contains(raw_url, '.mil') then 1.0 when contains(raw_url, '.org') then 0.95 else 0.0 end::double as f17,
  case when f5 is not null then any_n::double end as f18
from pair join wide using (qid, doc_id) left join pr using (ext_id)""").replace(_BASE + "\n,", _BASE + ",")


def _tf_df() -> str:
    return _with(f""",
q as ({_LATEST}),
word as (select qid, unnest({_tokens("query")}) as term from q where query is not null),
bag as (select distinct qid, term from word where term <> '' and term not in ({_STOP})),
tfs as (select doc_id, term, count(*) as tf from post where field = 'body' group by all)
select qid, doc_id, round(1 + sum(tf / df), 9) as score from bag join tfs using (term) join ts on ts.term = bag.term and ts.field = 'body'
group by 1, 2""").replace(_BASE + "\n,", _BASE + ",")


#: Lists of terms in the body, with the statistics that scores need.
_TF = """,
tf as (
  select p.doc_id, p.term, p.tf, ts.df, ts.ctf, dl.len, fs.average, fs.sum_ttf, n.n
  from (select doc_id, term, count(*) as tf from post where field = 'body' group by all) p join ts on ts.term = p.term and ts.field = 'body'
  join dl on dl.doc_id = p.doc_id and dl.field = 'body' join fs on fs.field = 'body' cross join n)"""


def _by_hand(sql: str) -> str:
    return f"with {_BASE}{_TF}\n{sql}"


def _indri_by_hand(weights: dict[str, float]) -> str:
    """A weighted product over all documents that hold one of the terms."""
    rows = ", ".join(f"('{w}', {x!r})" for w, x in weights.items())
    return _by_hand(f""", asked(term, w) as (values {rows}),
hit as (select distinct doc_id from tf where term in (select term from asked)),
p as (select a.term, a.w, coalesce(ts.ctf, 0) / (select sum_ttf from fs where field = 'body') as p from asked a left join ts on ts.term = a.term and ts.field = 'body')
select hit.doc_id, round(product(pow(0.4 * (coalesce(tf.tf, 0) + 2500.0 * p.p) / (coalesce(dl.len, 0) + 2500.0) + 0.6 * p.p, p.w)), 12) as score
from hit cross join p left join tf on tf.doc_id = hit.doc_id and tf.term = p.term
left join (select * from dl where field = 'body') dl on dl.doc_id = hit.doc_id group by 1""")


#: Trees written out without the parser and the rewrites of the engine, to check those as well.
_HAND = {
    "term_ranked": _by_hand("select doc_id, tf::double as score from tf where term = 'map'"),
    "bool_and_ranked": _by_hand("select doc_id, min(tf)::double as score from tf where term in ('have', 'map', 'from') group by 1 having count(*) = 3"),
    "bool_or_ranked": _by_hand(""", pairs as (select doc_id, min(tf) as s from tf where term in ('book', 'museum') group by 1 having count(*) = 2)
select doc_id, max(s)::double as score from (select * from pairs union all select doc_id, tf from tf where term = 'travel') group by 1"""),
    "sum_bm25": _by_hand(""", asked(term, times) as (values ('map', 2), ('travel', 1), ('museum', 1))
select doc_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len / average))), 6) as score
from tf join asked using (term) group by 1"""),
    "default_operator": _by_hand("""
select doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len / average))), 6) as score
from tf where term in ('travel', 'map', 'museum') group by 1"""),
    "and_indri": _indri_by_hand({"map": 1 / 3, "travel": 1 / 3, "museum": 1 / 3}),
    "wand_indri": _indri_by_hand({"map": 0.7 / 1.3, "travel": 0.2 / 1.3, "museum": 0.4 / 1.3}),
    "near": _by_hand(""", w as (select doc_id, term, pos from post where field = 'body' and term in ('see', 'fig')),
-- see and fig at distances of 1 to 3, where no position has two partners
pair as (select a.doc_id, a.pos as p, b.pos as q from w a join w b on a.doc_id = b.doc_id and a.term = 'see' and b.term = 'fig' and b.pos - a.pos between 0 and 3)
select doc_id, least(count(distinct p), count(distinct q))::double as score from pair group by 1"""),
}


def oracle_sql() -> dict[str, str]:
    out = {
        name: tree_sql(parse(text, model), model, f"select doc_id, round(s, {model.digits}) as score from result")
        for name, (text, model) in Q.TREES.items()
    }
    out |= _HAND
    flag = parse(Q.FLAGSHIP, Q.BM25)
    out["topk_run"] = tree_sql(flag, Q.BM25, """
select ext_id, row_number() over (order by score desc, ext_id) as rank, score
from (select ext_id, round(s, 6) as score from result join page using (doc_id) order by round(s, 6) desc, ext_id limit 100)""")
    out["scan_mode"] = tree_sql(parse("#SUM(#NEAR/3(from map) travel)", Q.BM25), Q.BM25, "select doc_id, round(s, 6) as score from result")
    out["scan_postings"] = _with("""
select field, term, doc_id, count(*) as tf, string_agg(pos, ' ' order by pos) as positions from post
where (field = 'body' and term in ('map', 'travel')) or (field = 'title' and term = 'city') group by field, term, doc_id""")
    out["live_postings"] = _with("""
select term, count(distinct doc_id) as df, count(*) as ctf from post
where field = 'body' and doc_id in (select doc_id from page where deleted_at is null) group by term""")
    out["term_vector"] = _with("select doc_id, field, term, count(*) as tf from post group by all")
    out["vector_stems"] = _with("""
select doc_id, field, row_number() over (partition by doc_id, field order by term) as i, term as stem, freq, df, ctf
from (select doc_id, field, term, count(*) as freq from post group by all) join ts using (field, term)""")
    out["vector_positions"] = _with("select doc_id, field, pos, term as stem from post")
    out["vector_accessors"] = """
select distinct doc_id, indexed_at, len(list_filter(stems, lambda s: s is not null)) as stems, list_sum(stems_freq) as occurrences
from term_vectors where field = 'body'"""
    out["doc_len"] = _with("select doc_id, field, len from dl")
    out["term_stats"] = _with("select field, term, df, ctf from ts")
    out["field_stats"] = _with("select field, doc_count, sum_ttf, round(average, 6) as average, n.n as n_docs from fs, n")
    out["analyze_tokens"] = f"""
select token, count(*) as n, token in ({_STOP}) as stop from (select unnest({_tokens("text")}) as token from documents) group by token"""
    ids = "select distinct lower(trim(ext_id)) as ext_id from qrels where qid is not null and trim(ext_id) <> ''"
    out["external_ids"] = f"select ext_id, doc_id from ({ids}) join (select doc_id, lower(trim(ext_id)) as ext_id from documents) using (ext_id)"
    out["unmatched_ids"] = f"select ext_id from ({ids}) where ext_id not in (select lower(trim(ext_id)) from documents where ext_id is not null)"
    out["load_queries"] = _LATEST
    out["bag_run"] = _with(f""",
q as ({_LATEST}),
word as (select qid, unnest(string_split_regex(query, '[\\s,]+')) as w from q where query is not null and not starts_with(ltrim(query), '#')),
term as (select qid, ({_tokens("w")})[1] as term from word),
used as (select * from term where term <> '' and term not in ({_STOP})),
tfs as (select doc_id, term, count(*) as tf from post where field = 'body' group by all),
sc as (
  select u.qid, x.doc_id, round(sum(ln((n.n - ts.df + 0.5) / (ts.df + 0.5)) * x.tf / (x.tf + 1.2 * (0.25 + 0.75 * dl.len / fs.average))), 6) as score
  from used u join tfs x using (term) join ts on ts.term = u.term and ts.field = 'body' join fs on fs.field = 'body'
  join dl on dl.doc_id = x.doc_id and dl.field = 'body' cross join n group by 1, 2)
select qid, ext_id, row_number() over (partition by qid order by score desc, ext_id) as rank, score
from sc join page using (doc_id) qualify rank <= 100""").replace(_BASE + "\n,", _BASE + ",")
    out["dummy_row"] = "select 10 as qid, 'Q0' as q0, 'dummy' as ext_id, 1 as rank, 0.0::double as score, 'run-1' as run_id"
    out["initial_ranking"] = f"with {_FILE_RUNS} select run_id, qid, doc_id, score from line join (select doc_id, lower(trim(ext_id)) as ext_id from documents) using (ext_id) where k <= {Q.FB_DOCS}"
    out["file_queries"] = "select qid, trim(query) as query from queries where qid is not null and query is not null and not contains(query, chr(10)) and not contains(query, chr(13))"
    out["file_qrels"] = """
select qid, coalesce(nullif(trim(iter), ''), '0') as iter, lower(trim(ext_id)) as ext_id, rel
from qrels where qid is not null and trim(ext_id) <> '' and rel is not null"""
    out["file_pagerank"] = "select lower(trim(ext_id)) as ext_id, pagerank from pagerank where trim(ext_id) <> '' and pagerank is not null and not isnan(pagerank)"
    out["file_run"] = """
select qid, lower(trim(ext_id)) as ext_id, score, count(*) as n
from runs where qid is not null and trim(ext_id) <> '' and score is not null and not isnan(score) group by all"""
    out["prf_terms"] = _prf("\nselect term, rank, round(score * 1e6, 4) as score from best")
    out["prf_all_queries"] = _with(f""",
{_FILE_RUNS},
fb as (select run_id, qid, doc_id, score from line join page using (ext_id) where k <= {Q.FB_DOCS}),
body as (select doc_id, term, count(*) as tf from post where field = 'body' group by all),
cand as (select distinct run_id, qid, term from fb join body using (doc_id) where not regexp_matches(term, '^.+[.,]')),
learned as (
  select c.run_id, c.qid, c.term, printf('%.{Q.FB_DIGITS - 1}e', sum((coalesce(b.tf, 0) + {Q.FB_MU} * p) / (coalesce(len, 0) + {Q.FB_MU}) * fb.score * ln(1 / p)))::double as score
  from cand c join fb on fb.run_id = c.run_id and fb.qid = c.qid
  join (select term, ctf / (select sum_ttf from fs where field = 'body') as p from ts where field = 'body') pt on pt.term = c.term
  left join body b on b.doc_id = fb.doc_id and b.term = c.term
  left join (select * from dl where field = 'body') dl on dl.doc_id = fb.doc_id group by all),
best as (
  select run_id, qid, term, row_number() over (partition by run_id, qid order by score desc, term) as rank, score
  from learned qualify rank <= {Q.FB_TERMS})
select *, '#WAND( ' || string_agg(printf('%.{Q.FB_DIGITS - 1}e', score) || ' ' || term, ' ' order by rank) over (
  partition by run_id, qid rows between unbounded preceding and unbounded following) || ' )' as learned from best""").replace(_BASE + "\n,", _BASE + ",")
    out["prf_rerank"] = _prf(f""",
wt as (select term, {1 - Q.FB_WEIGHT} * score / (select sum(score) from best) as w from best),
lp as (
  select d.doc_id, max(tf) as hit, exp(sum(w * ln({Q.INDRI.lam} * (coalesce(tf, 0) + {Q.INDRI.mu} * p) / (coalesce(len, 0) + {Q.INDRI.mu}) + {1 - Q.INDRI.lam} * p))) as s
  from documents d cross join wt join pt using (term) left join tfs using (doc_id, term)
  left join (select * from dl where field = 'body') dl using (doc_id) group by 1)
select doc_id, round(pow(o.s, {Q.FB_WEIGHT}) * lp.s * 1e6, 4) as score from d_x o join lp using (doc_id)
where lp.hit is not null or doc_id in (select doc_id from n_x)""")
    out["ltr_url_features"] = _with("""
select doc_id, (length(coalesce(raw_url, '')) - length(replace(coalesce(raw_url, ''), '/', '')))::double as f2,
  case when contains(lower(raw_url), 'wikipedia.org') then 1.0 else 0.0 end::double as f3,
  case when contains(raw_url, '.edu') or contains(raw_url, '.mil') then 1.0 when contains(raw_url, '.org') then 0.95 else 0.0 end::double as f17
from page""")
    out["ltr_features"] = _letor()
    item = ", ".join(f"max(case when not isnan({f}) then {f} end) as {f}" for f in FEATURES)
    scaled = ", ".join(
        f"round(coalesce(case when max({f}) over w > min({f}) over w then ({f} - min({f}) over w) / (max({f}) over w - min({f}) over w) end, 0), 9) as {f}"
        for f in FEATURES
    )
    items = f"select qid, lower(trim(ext_id)) as ext_id, max(rel) as rel, {item} from features group by 1, 2"
    out["ltr_normalized"] = f"select qid, ext_id, {scaled} from ({items}) window w as (partition by qid)"
    on = [i for i in range(1, 19) if i not in (7, 10, 13, 16)]
    raw = ", ".join(
        f"coalesce(case when max({f}) over w > min({f}) over w then ({f} - min({f}) over w) / (max({f}) over w - min({f}) over w) end, 0) as {f}"
        for f in FEATURES
    )
    text = ", ".join(f"printf('{i}:%.6f', f{i})" for i in on)
    out["ltr_svmlight"] = f"select concat_ws(' ', rel::varchar, 'qid:' || qid, {text}, '#', ext_id) as line from (select qid, ext_id, rel, {raw} from ({items}) window w as (partition by qid))"
    out["svm_weights"] = " union all ".join(
        f"select {i} as feature, round(sum(rel * coalesce(case when not isnan(f{i}) then f{i} end, 0)), 6) as weight from features where rel is not null" for i in range(1, 19)
    )
    total = " + ".join(f"{w} * f{i}" for i, w in enumerate(Q.GIVEN, 1))
    out["ltr_rerank"] = f"""
select qid, ext_id, score, row_number() over (partition by qid order by score desc, ext_id nulls first) as rank
from (select qid, ext_id, round({total}, 9) as score from (select qid, ext_id, {raw} from ({items}) window w as (partition by qid)))"""
    out["tf_df_score"] = _tf_df()
    out["avg_stem_len"] = _with("select doc_id, round(avg(length(term)), 9) as length from post where field = 'body' group by 1")
    return out
