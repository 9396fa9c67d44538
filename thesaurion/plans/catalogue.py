"""One query per operator of the terminology engine over the delivered tables, with its SQL."""

from __future__ import annotations

import uuid


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thesaurion.functions.curie import curie
from thesaurion.functions.text import canonical_text, search_text, tokens
from thesaurion.operators import documents as docs
from thesaurion.operators import export, graph, lookup, paths, retrieval
from thesaurion.operators import similarity as sim
from thesaurion.plans.fixtures import ANNOTATED, CONCEPTS, EDGES, GEO_LINKS, PART_LINKS, REACTIONS, SCORES, concepts, edges, oracle, read
from thesaurion.runtime import Scratch, shared_dir, table
from thesaurion.streaming.ingest import ConceptStore, ingest, sessions, windowed_counts

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return keep


def _ids(spark: SparkSession, d: str, prefix: str) -> DataFrame:
    return concepts(spark, d).where(F.col("prefix") == prefix).select("prefix", "concept_id")


_DOWN = f"h as (select distinct prefix_from cp, id_from ci, prefix_to pp, id_to pi from ({EDGES}) where rel_type in ('is_a', 'part_of'))"
_CLOSURE = f"with recursive {_DOWN}, r(rp, ri, p, i) as (select pp, pi, cp, ci from h union select r.rp, r.ri, h.cp, h.ci from r join h on h.pp = r.p and h.pi = r.i)"


@query(f"with {_DOWN}, a as (select distinct 'region' root_prefix, pi root_id, ci i, cp p from h where pp = 'region'), b as (select a.root_id, h.cp p, h.ci i from a join h on h.pp = a.p and h.pi = a.i) select root_id, p prefix, i descendant_id from (select root_id, p, i from a union select * from b) x")
def expand_bounded_geo(spark, d):
    out = graph.reach(edges(spark, d), _ids(spark, d, "region"), Scratch(spark, "expand"), depth=2)
    return out.select("root_id", "prefix", F.col("concept_id").alias("descendant_id"))


@query(_CLOSURE + ", n as (select distinct id from (select ci id from h where cp = 'part' union all select pi from h where pp = 'part') y) select n.id root_id, r.i descendant_id from n left join r on r.rp = 'part' and r.ri = n.id")
def expand_unbounded_part(spark, d):
    out = graph.related(edges(spark, d).where("prefix_from = 'part' and prefix_to = 'part' and rel_type = 'is_a'"), _ids(spark, d, "part"), Scratch(spark, "expand"))
    return out.select(F.col("concept_id").alias("root_id"), F.explode_outer("related").alias("descendant_id"))


@query(_CLOSURE + " select ri root_id, i descendant_id from (select *, row_number() over (partition by ri order by i) k from (select distinct ri, i from r where rp = 'nation') y) z where k <= 5")
def expand_limited(spark, d):
    out = graph.related(edges(spark, d), _ids(spark, d, "nation"), Scratch(spark, "expand"), limit=5)
    return out.select(F.col("concept_id").alias("root_id"), F.explode("related").alias("descendant_id"))


@query(_CLOSURE + " select distinct i concept_id, rp ancestor_prefix, ri ancestor_id from r where p = 'customer'")
def ancestors_unbounded(spark, d):
    out = graph.reach(edges(spark, d), _ids(spark, d, "customer"), Scratch(spark, "up"), up=True)
    return out.select(F.col("root_id").alias("concept_id"), F.col("prefix").alias("ancestor_prefix"), F.col("concept_id").alias("ancestor_id"))


@query(f"select child concept_id, parent parent_id from ({PART_LINKS}) x")
def ancestors_depth1(spark, d):
    out = graph.related(edges(spark, d), _ids(spark, d, "part"), Scratch(spark, "up"), up=True, depth=1)
    return out.select("concept_id", F.explode("related").alias("parent_id"))


def _hop_sql(rel: str, out: bool, e: str, ask: str) -> str:
    a, b = ("from", "to") if out else ("to", "from")
    return f"with e as ({e}), n as (select distinct id_from i from e union select id_to from e), q as ({ask}) select q.i concept_id, x.r related_id from q left join (select distinct id_{a} i, id_{b} r from e where rel_type = '{rel}') x on x.i = q.i where q.i in (select i from n)"


_PART_E = f"select * from ({EDGES}) where prefix_from = 'part' and prefix_to = 'part'"
_PART_Q = "select cast(p_partkey as varchar) i from {part}"


@query(_hop_sql("replaced_by", False, _PART_E, _PART_Q))
def replaced_by_in(spark, d):
    own = edges(spark, d).where("prefix_from = 'part' and prefix_to = 'part'")
    return graph.replaced(own, _ids(spark, d, "part")).select("concept_id", "related_id")


@query(_hop_sql("replaced_by", True, _PART_E, _PART_Q))
def replaced_by_out(spark, d):
    own = edges(spark, d).where("prefix_from = 'part' and prefix_to = 'part'")
    return graph.replacing(own, _ids(spark, d, "part")).select("concept_id", "related_id")


@query(f"select prefix_from, prefix_to, count(*) n from ({EDGES}) x group by 1, 2")
def count_annotations(spark, d):
    return graph.count_edges(edges(spark, d))


@query(f"""select c.prefix, c.n concepts, coalesce(e.n, 0) relationships, coalesce(v.n, 0) vectors, c.n > 0 loaded from (select prefix, count(*) n from ({CONCEPTS}) x group by 1) c
 left join (select prefix_from prefix, count(*) n from ({EDGES}) y where prefix_from = prefix_to group by 1) e on e.prefix = c.prefix
 left join (select 'part' prefix, count(*) n from {{embeddings}}) v on v.prefix = c.prefix""")
def vocabulary_status(spark, d):
    c = concepts(spark, d)
    vectors = table(spark, d, "embeddings").select(F.lit("part").alias("prefix"))
    return docs.vocabulary_status(c, edges(spark, d), vectors, c.select("prefix").distinct())


def _network(spark, d):
    e = edges(spark, d, REACTIONS)
    # what a node is follows from the links it stands in
    kinds = [("id_from", "rel_type like 'has%'", "reaction"), ("id_to", "rel_type like 'has%'", "gene"), ("id_from", "rel_type = 'part_of'", "pathway"), ("id_to", "rel_type = 'part_of'", "pathway")]
    parts = [e.where(w).select(F.col(c).alias("concept_id"), F.lit(t).alias("t")) for c, w, t in kinds]
    c = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).groupBy("concept_id").agg(F.collect_set("t").alias("concept_types"))
    return e, c.withColumn("prefix", F.lit("reactome"))


def _typed_sql(rel: str, out: bool, src: str) -> str:
    a, b = ("from", "to") if out else ("to", "from")
    return f"with e as ({REACTIONS}), q as ({src}) select q.i concept_id, x.r related_id from q left join (select distinct id_{a} i, id_{b} r from e where rel_type = '{rel}') x on x.i = q.i"


_PATHWAYS = "select distinct id_from i from e where rel_type = 'part_of' union select id_to from e where rel_type = 'part_of'"
_GENES, _REACTS = "select distinct id_to i from e where rel_type like 'has%'", "select distinct id_from i from e where rel_type like 'has%'"
for _name, _rel, _out, _src in (
    ("sub_pathways", "part_of", False, _PATHWAYS), ("super_pathways", "part_of", True, _PATHWAYS), ("reaction_inputs", "has_input", True, _REACTS),
    ("reaction_outputs", "has_output", True, _REACTS), ("consumed_in", "has_input", False, _GENES), ("produced_in", "has_output", False, _GENES)):

    def _typed(spark, d, name=_name):
        e, c = _network(spark, d)
        return graph.typed_hop(name, e, c, c).select("concept_id", "related_id")

    QUERIES[f"typed_{_name}"] = _typed
    ORACLES[f"typed_{_name}"] = oracle(_typed_sql(_rel, _out, _src))


@query(f"select a concept_id, b mapped_id, 1 hops from ({ANNOTATED}) x")
def map_1hop(spark, d):
    return paths.map_terms(edges(spark, d), _ids(spark, d, "part"), "supplier", Scratch(spark, "map")).select("concept_id", "mapped_id", "hops")


@query(f"select distinct a concept_id, cast(s_nationkey as varchar) mapped_id, 2 hops from ({ANNOTATED}) x join {{supplier}} on cast(s_suppkey as varchar) = b")
def map_2hop(spark, d):
    return paths.map_terms(edges(spark, d), _ids(spark, d, "part"), "nation", Scratch(spark, "map"), max_hops=2).select("concept_id", "mapped_id", "hops")


@query(f"select distinct a concept_id, cast(c_custkey as varchar) mapped_id, 3 hops from ({ANNOTATED}) x join {{supplier}} on cast(s_suppkey as varchar) = b join {{customer}} on c_nationkey = s_nationkey")
def map_3hop(spark, d):
    return paths.map_terms(edges(spark, d), _ids(spark, d, "part"), "customer", Scratch(spark, "map"), max_hops=3).select("concept_id", "mapped_id", "hops")


@query(f"""with recursive l as ({PART_LINKS}), q as (select cast(p_partkey as varchar) s, cast(p_partkey // 24 as varchar) e from {{part}} where p_partkey >= 24),
 w(s, e, n, nodes) as (select s, e, s, ['part:' || s] from q union all select w.s, w.e, l.parent, list_append(w.nodes, 'part:' || l.parent) from w join l on l.child = w.n where w.n <> w.e and not list_contains(w.nodes, 'part:' || l.parent)),
 f as (select s, e, nodes, len(nodes) k from w where n = e)
 select s query_id, cast(k as integer) length, array_to_string(nodes, '>') path_text from f
 where not exists (select 1 from f g where g.s = f.s and g.k < f.k and len(list_filter(g.nodes, lambda x: list_contains(f.nodes, x))) = g.k)""")
def trace_directed(spark, d):
    """Every part from 24 on to the part at a 24th of its number; longer ways round stand in no shorter one's order here."""
    q = read(spark, d, "select cast(p_partkey as string) query_id, 'part' prefix_start, cast(p_partkey as string) id_start, 'part' prefix_end, cast(p_partkey div 24 as string) id_end from {part} where p_partkey >= 24")
    out = paths.trace(edges(spark, d).where("prefix_to = 'part'"), q, Scratch(spark, "trace"), "is_a")
    return out.select("query_id", "length", F.array_join("nodes", ">").alias("path_text"))


@query("""select cast(s_suppkey as varchar) query_id, case when s_nationkey = c_nationkey then 3 else 5 end length from {supplier} join {customer} on c_custkey = s_suppkey
 join {nation} a on a.n_nationkey = s_nationkey join {nation} b on b.n_nationkey = c_nationkey where a.n_regionkey = b.n_regionkey""")
def trace_shortest_undirected(spark, d):
    q = read(spark, d, "select cast(s_suppkey as string) query_id, 'supplier' prefix_start, cast(s_suppkey as string) id_start, 'customer' prefix_end, cast(s_suppkey as string) id_end from {supplier}")
    return paths.trace_undirected(edges(spark, d), q, Scratch(spark, "trace"), ("part_of",), 4).select("query_id", "length")




@query(f"""with q as (select distinct lower(p_name) q from {{part}}), c as (select distinct cast(p_partkey as varchar) id, p_name label from {{part}}),
 m as (select q, id, label, id || ' ' || regexp_replace(label, '[()"''\\s]', '', 'g') text from q, c
   where len(list_filter(string_split(q, ' '), lambda w: len(w) > 2)) > 0 and len(list_filter(list_filter(string_split(q, ' '), lambda w: len(w) > 2), lambda w: not contains(lower(id), w) and len(list_filter(string_split(lower(label), ' '), lambda t: len(t) > 2 and contains(t, w))) = 0)) = 0),
 s as (select *, case when strpos(text, replace(q, ' ', '')) > 0 then strpos(text, replace(q, ' ', '')) - 1 else 1000000000 end score from m)
 select q query_id, id concept_id, cast(score as integer) score, cast(k as integer) rank from (select *, row_number() over (partition by q order by score, len(label), id) k from s) x where k <= 20""")
def autocomplete_rank(spark, d):
    """Every part name as a query."""
    c = concepts(spark, d).where("prefix = 'part'")
    q = c.select(F.lower("label").alias("query_id"), "prefix", F.lower("label").alias("query")).distinct()
    return docs.auto_complete(c, q, 20).select("query_id", "concept_id", "score", "rank")


@query("""with t as (select distinct cast(p_partkey as varchar) id, w from (select p_partkey, unnest(string_split(lower(p_name), ' ')) w from {part}) x where len(w) > 2 union select cast(p_partkey as varchar), cast(p_partkey as varchar) from {part}),
 g as (select distinct id, substr(w, a, n) ngram from (select id, w, unnest(range(1, len(w) + 1)) a from t) y, (select unnest(range(3, 21)) n) z where a + n - 1 <= len(w))
 select ngram, count(*) n_concepts from g group by 1""")
def ngram_index_stats(spark, d):
    return docs.ngram_index(concepts(spark, d).where("prefix = 'part'")).groupBy("ngram").agg(F.count(F.lit(1)).alias("n_concepts"))


@query("select cast(doc_id as varchar) concept_id, cast(doc_id as varchar) || case when source is null then '' else ' ' || regexp_replace(source, '[()\"''\\s]', '', 'g') end || case when lang is null then '' else ' ' || regexp_replace(lang, '[()\"''\\s]', '', 'g') end text from {documents}")
def search_texts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("concept_id"), search_text(F.col("doc_id").cast("string"), "source", F.when(F.col("lang").isNotNull(), F.array("lang"))).alias("text"))


@query("select cast(id as varchar) concept_id, regexp_replace(coalesce(cast(concept_id as varchar), '') || ': ' || coalesce(term, '') || ' (' || cast(feed_seq as varchar) || ')', '^[ :]+|[ :]+$', '', 'g') text from {definition}")
def canonical_texts(spark, d):
    return table(spark, d, "definition").select(F.col("id").cast("string").alias("concept_id"), canonical_text(F.col("concept_id").cast("string"), "term", F.array(F.col("feed_seq").cast("string"))).alias("text"))


@query("select q.pos, q.i concept_id, p_name label from (select p_partkey pos, cast(p_partkey as varchar) i from {part} union all select -1 - p_partkey, 'x' || cast(p_partkey as varchar) from {part}) q left join {part} p on cast(p_partkey as varchar) = q.i")
def get_by_ids_ordered(spark, d):
    q = read(spark, d, "select p_partkey pos, 'part' prefix, cast(p_partkey as string) concept_id from {part} union all select -1 - p_partkey, 'part', concat('x', cast(p_partkey as string)) from {part}")
    return docs.get_by_ids(concepts(spark, d), q).select("pos", "concept_id", "label")


@query()
def random_ids(spark, d):
    return docs.random_ids(concepts(spark, d), 100, seed=1)


@query("select id, feed_seq, effective_time, active, concept_id from (select *, row_number() over (partition by id order by effective_time desc, feed_seq desc) k from {definition}) x where k = 1")
def latest_version(spark, d):
    return docs.latest_rows(table(spark, d, "definition"), "id", "effective_time", "feed_seq").select("id", "feed_seq", "effective_time", "active", "concept_id")


@query("select concept_id, arg_min(term, feed_seq) filter (active = 1) p, arg_min(term, feed_seq) s, count(*) filter (active <> 1) n_synonyms, coalesce(p, s) label from (select * from {definition} where term is not null and concept_id is not null) x group by 1")
def label_synonym_fold(spark, d):
    t = table(spark, d, "definition").where("term is not null and concept_id is not null")
    t = t.select("concept_id", F.when(F.col("active") == 1, "P").otherwise("S").alias("kind"), "term", F.col("feed_seq").alias("place"))
    return lookup.fold_labels(t).select("concept_id", "label", F.size("synonyms").cast("long").alias("n_synonyms"))


ORACLES["label_synonym_fold"] = f"select concept_id, label, n_synonyms from ({ORACLES['label_synonym_fold']}) y"


@query("""with w as (select distinct symbol s from {symbol} where symbol_status = 'Entry Withdrawn'),
 a as (select symbol s from {symbol} where symbol_status <> 'Entry Withdrawn' union select unnest(string_split(alias_symbol, '|')) from {symbol} where symbol_status <> 'Entry Withdrawn')
 select s symbol, 'active' status from a where trim(s) <> '' and s not in (select s from w) union all select s, 'deprecated' from w""")
def symbol_sets(spark, d):
    s = table(spark, d, "symbol")
    own = s.where("symbol_status <> 'Entry Withdrawn'")
    return lookup.symbol_sets(own.select("symbol"), own.select(F.explode(F.split("alias_symbol", r"\|"))), s.where("symbol_status = 'Entry Withdrawn'").select("symbol"))


@query("select distinct cast(l_partkey as varchar) src, cast(l_suppkey as varchar) dst, k as \"key\" from (select l_partkey, l_suppkey, l_returnflag k from {lineitem} union all select l_partkey, l_suppkey, l_linestatus from {lineitem}) x")
def merge_edges_keys(spark, d):
    rows = read(spark, d, "select 'part' prefix_from, cast(l_partkey as string) id_from, 'supplier' prefix_to, cast(l_suppkey as string) id_to, 'related' rel_type, array(l_returnflag, l_linestatus) keys, cast(null as map<string,string>) props from {lineitem}")
    return graph.merge_edges(rows).select(F.col("id_from").alias("src"), F.col("id_to").alias("dst"), F.explode("keys").alias("key"))


@query("select doc_id, coalesce(upper(lang), lang) lang, source, n_chars from {documents}")
def upsert_documents(spark, d):
    old = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.upsert(old, old.where("lang is not null").select("doc_id", F.upper("lang").alias("lang")), ["doc_id"])


@query("""select feed_seq, case when gene_id is null or trim(gene_id) = '' then null when lower(trim(gene_id)) like 'reactome:%' then 'reactome:' || substr(trim(gene_id), 10) else 'reactome:' || trim(gene_id) end curie
 from (select feed_seq, regexp_replace(gene_id, '[\\t\\n]+$', '') gene_id from {gene_reaction}) x""")
def curie_normalise(spark, d):
    return table(spark, d, "gene_reaction").select("feed_seq", curie(F.lit("reactome"), F.regexp_replace("gene_id", r"[\t\n]+$", ""), strict=False).alias("curie"))


_ROLL = f"""with recursive l as ({PART_LINKS}), a as (select a id, count(*) w from ({ANNOTATED}) x group by 1), n as (select child id from l union select parent from l union select id from a),
 walk(id, w) as (select id, w from a union all select l.parent, walk.w from walk join l on l.child = walk.id), r as (select n.id, coalesce(sum(walk.w), 0) n from n left join walk on walk.id = n.id group by 1)"""


def _part_links(spark, d):
    return read(spark, d, PART_LINKS), read(spark, d, ANNOTATED).toDF("id", "corpus_id")


@query(_ROLL + " select id concept_id, cast(n as double) n from r")
def annotation_rollup(spark, d):
    links, ann = _part_links(spark, d)
    return sim.roll_up(links, ann.groupBy("id").agg(F.count(F.lit(1)).alias("w")), Scratch(spark, "roll")).select(F.col("id").alias("concept_id"), "n")


@query(_ROLL + " select id concept_id, round(abs(-ln(n / (select max(n) from r))), 6) ic from r where n > 0")
def information_content(spark, d):
    links, ann = _part_links(spark, d)
    ic = sim.information_content(sim.roll_up(links, ann.groupBy("id").agg(F.count(F.lit(1)).alias("w")), Scratch(spark, "ic")))
    return ic.where("ic is not null").select(F.col("id").alias("concept_id"), F.round("ic", 6).alias("ic"))


#: Suppliers, nations and regions as target, parts as corpus; ids with their vocabulary.
_GEO = f"select p1 || ':' || i1 child, p2 || ':' || i2 parent from ({GEO_LINKS}) g where p1 <> 'customer'"
_GEO_ANN = f"select 'supplier:' || b id, a corpus_id from ({ANNOTATED}) s"
_UP = f"l as ({_GEO}), ann as ({_GEO_ANN}), n0 as (select child id from l union select parent from l), up(id, anc) as (select id, id from n0 union select up.id, l.parent from up join l on l.child = up.anc)"


@query(f"""with recursive {_UP}, w as (select id, count(*) w from ann group by 1), r as (select up.anc id, sum(w) n from up join w on w.id = up.id group by 1), t as (select max(n) top from r),
 ic as (select id, n, abs(-ln(n / top)) ic from r, t), p as (select a.id id_1, b.id id_2, max(struct_pack(ic := m.ic, n := m.n)) m from up a join up b on a.anc = b.anc and a.id < b.id join ic m on m.id = a.anc group by 1, 2)
 select id_1, id_2, round(2 * m.ic / (x.ic + y.ic) * (1 - m.n / top), 6) score from p join ic x on x.id = id_1 join ic y on y.id = id_2, t where x.ic + y.ic > 0 and 2 * m.ic / (x.ic + y.ic) * (1 - m.n / top) >= 0.2""")
def relevance_pairs(spark, d):
    out = sim.relevance(read(spark, d, _GEO.replace("varchar(20)", "string")), read(spark, d, _GEO_ANN), Scratch(spark, "rel"))
    return out.select("id_1", "id_2", F.round("score", 6).alias("score"))


@query(f"""with recursive {_UP}, s as (select distinct up.anc id, corpus_id from up join ann on ann.id = up.id), k as (select id, count(*) k from s group by 1), t as (select count(distinct corpus_id) n from ann),
 c as (select a.id id_1, b.id id_2, count(*) x from s a join s b on a.corpus_id = b.corpus_id and a.id < b.id group by 1, 2),
 z as (select id_1, id_2, x, u.k k1, v.k k2, n, case when x = n then 1.0 else (1 + ln((x * n) / (cast(u.k as double) * v.k)) / ln(cast(n as double) / x)) / 2 end * x / (u.k + v.k - x) score from c join k u on u.id = id_1 join k v on v.id = id_2, t)
 select id_1, id_2, round(score, 6) score from z where score >= 0.2""")
def co_annotation_pairs(spark, d):
    out = sim.co_annotation(read(spark, d, _GEO), read(spark, d, _GEO_ANN), Scratch(spark, "coann"))
    return out.select("id_1", "id_2", F.round("score", 6).alias("score"))


@query()
def weighted_content(spark, d):
    corpus, _ = _part_links(spark, d)
    t, _ = sim.weighted_content(read(spark, d, _GEO), corpus, read(spark, d, _GEO_ANN), Scratch(spark, "weighed"))
    return t.where("ic is not null").select(F.col("id").alias("concept_id"), F.round("ic", 4).alias("ic"))


_BOTH = f"s as ({SCORES}), b as (select id_from i, id_to i2, score_key, score from s union select id_to, id_from, score_key, score from s)"


@query(f"with {_BOTH} select i concept_id, i2 neighbour_id, max(score) best from b where score >= 0.6 group by 1, 2")
def similar_aggregate(spark, d):
    s = read(spark, d, SCORES)
    ask = s.select(F.col("id_from").alias("concept_id")).union(s.select("id_to")).distinct().select(F.lit("snomed").alias("prefix"), "concept_id", F.lit(0.6).alias("threshold"))
    return retrieval.similar_best(s, ask).select("concept_id", "neighbour_id", "best")


@query(f"with {_BOTH}, v as (select i, i2, score_key, max(score) score from b where score >= 0.3 and (score_key = 'relevance' or score_key like 'relevance:%') group by 1, 2, 3), m as (select i, i2, max(score) best from v group by 1, 2), k as (select *, row_number() over (partition by i order by best desc, i2) r from m) select k.i concept_id, k.i2 neighbour_id, score_key, score, cast(r as integer) rank from k join v on v.i = k.i and v.i2 = k.i2 where r <= 5")
def similar_full(spark, d):
    s = read(spark, d, SCORES)
    ask = s.select(F.col("prefix_from").alias("prefix"), F.col("id_from").alias("concept_id")).union(s.select("prefix_to", "id_to")).distinct()
    return retrieval.similar_full(s, ask, threshold=0.3, method="relevance", limit=5).select("concept_id", "neighbour_id", "score_key", "score", "rank")


@query(f"with {_BOTH}, c as (select distinct concept_id from {{graph_concept}} where prefix = 'snomed' and status = 'active'), m as (select i, i2, max(score) score from b where score >= 0.4 and i2 in (select concept_id from c) group by 1, 2) select i concept_id, i2 target_id, score, cast(k as integer) rank from (select *, row_number() over (partition by i order by score desc, i2) k from m) x where k <= 3")
def translate(spark, d):
    s = read(spark, d, SCORES)
    ask = s.select(F.col("prefix_from").alias("prefix"), F.col("id_from").alias("concept_id")).union(s.select("prefix_to", "id_to"))
    allowed = table(spark, d, "graph_concept").where("prefix = 'snomed' and status = 'active'")
    return retrieval.translate(s, ask, allowed, 0.4, 3).select("concept_id", "target_id", "score", "rank")


@query(f"select k.score_key, count(s.score_key) n from (select distinct score_key from {{similar_snomed_concept}} union select 'weighed-relevance:none') k left join ({SCORES}) s on s.score_key = k.score_key group by 1")
def similarity_status(spark, d):
    keys = table(spark, d, "similar_snomed_concept").select("score_key").distinct().union(spark.createDataFrame([("weighed-relevance:none",)], "score_key string"))
    return graph.count_scores(read(spark, d, SCORES), keys)


@query("""with p as (select q.vec_id query_id, v.vec_id concept_id, list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[])) c from {embeddings} q, {embeddings} v where q.vec_id % 50 = 0)
 select query_id, concept_id, round(c, 6) cosine from (select *, row_number() over (partition by query_id order by c desc, concept_id) k from p) x where k <= 10""")
def vector_topk(spark, d):
    """As queries every vector whose id is divisible by 50, against all."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("concept_id"), F.col("embedding").alias("vector"))
    q = v.where("concept_id % 50 = 0").select(F.col("concept_id").alias("query_id"), "vector")
    return retrieval.vector_top_k(v, q, 10).select("query_id", "concept_id", F.round("cosine", 6).alias("cosine"))


@query("select a.vec_id id_1, b.vec_id id_2, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) cosine from {embeddings} a join {embeddings} b on b.vec_id = a.vec_id + 1")
def vector_pairs_cosine(spark, d):
    a = table(spark, d, "embeddings").select(F.col("vec_id").alias("id_1"), F.col("embedding").alias("u"))
    b = a.select(F.col("id_1").alias("id_2"), F.col("u").alias("v"))
    return a.join(b, F.col("id_2") == F.col("id_1") + 1).select("id_1", "id_2", F.round(retrieval.cosine("u", "v"), 6).alias("cosine"))


@query()
def embedding_text(spark, d):
    return retrieval.hashed_embedding(table(spark, d, "definition").select("feed_seq", "term"), "term", 32).select("feed_seq", F.size("vector").alias("dim"))


_NODES = f"n as (select prefix, concept_id, row_number() over (order by prefix, concept_id) - 1 nid from (select prefix_from prefix, id_from concept_id from ({EDGES}) x union select prefix_to, id_to from ({EDGES}) y) z)"


@query(f"with {_NODES} select nid, prefix, concept_id from n")
def graph_export_nodes(spark, d):
    return export.export_nodes(edges(spark, d), Scratch(spark, "nodes"))


_EXPORT = f"with {_NODES}, x as (select distinct a.nid src, rel_type rel, b.nid dst from ({EDGES}) e join n a on a.prefix = prefix_from and a.concept_id = id_from join n b on b.prefix = prefix_to and b.concept_id = id_to)"


@query(_EXPORT + " select src, rel, dst from x")
def graph_export_edges(spark, d):
    e = edges(spark, d)
    return export.export_edges(e, export.export_nodes(e, Scratch(spark, "nodes")))


@query(_EXPORT + ", g as (select nid, (select count(*) from x where src = nid) + (select count(*) from x where dst = nid) degree from n) select nid, degree, cast(coalesce(sum(degree) over (order by nid rows between unbounded preceding and 1 preceding), 0) as bigint) as start from g")
def csr_degrees(spark, d):
    e, scratch = edges(spark, d), Scratch(spark, "csr")
    nodes = scratch.cut(export.export_nodes(e, scratch))
    return export.csr(export.export_edges(e, nodes), nodes, scratch)


@query()
def random_walks(spark, d):
    e, scratch = edges(spark, d), Scratch(spark, "walks")
    nodes = scratch.cut(export.export_nodes(e, scratch))
    return export.random_walks(export.export_edges(e, nodes), scratch, 4).select("start", "walk", F.size("tokens").alias("n_tokens"))


@query("""with t as (select feed_seq, list_filter(string_split_regex(regexp_replace(lower(term), '[()"''\\s]', ' ', 'g'), ' +'), lambda w: len(w) > 2) t from {definition} where term is not null),
 p as (select feed_seq, t, unnest(range(1, len(t) + 1)) i from t), q as (select t[i] centre, t[j] context from (select *, unnest(range(greatest(1, i - 2), least(len(t), i + 2) + 1)) j from p) x where i <> j)
 select centre, context, count(*) n from q group by 1, 2""")
def skipgram_pairs(spark, d):
    seq = table(spark, d, "definition").where("term is not null").select("feed_seq", tokens("term").alias("t"))
    return export.skip_grams(seq, "feed_seq", "t", 2).groupBy("centre", "context").agg(F.count(F.lit(1)).alias("n"))


@query(_CLOSURE + f", o as (select 'region' p, i1 i, cast(i1 as integer) pr from (select cast(r_regionkey as varchar) i1 from {{region}}) x), m as (select p, i, pr from o union all select r.p, r.i, o.pr from r join o on o.p = r.rp and o.i = r.ri) select c.prefix, c.concept_id, coalesce('type ' || cast(max(m.pr) as varchar), 'structural') as type from ({CONCEPTS}) c left join m on m.p = c.prefix and m.i = c.concept_id group by 1, 2")
def subtree_types(spark, d):
    roots = _ids(spark, d, "region").select("prefix", "concept_id", F.concat(F.lit("type "), "concept_id").alias("type"), F.col("concept_id").cast("int").alias("priority"))
    reached = graph.reach(edges(spark, d), roots, Scratch(spark, "types"))
    return export.subtree_types(reached, roots, concepts(spark, d))


_URL = "http://example.org/fhir/CodeSystem/"


def _codes(spark, d):
    return read(spark, d, f"select '{_URL}snomed' system, from_id code from {{similar_snomed_concept}} union select '{_URL}mondo', from_id from {{similar_snomed_concept}} union select 'urn:none', from_id from {{similar_snomed_concept}}")


def _graph_concepts(spark, d):
    from thesaurion.schema import concepts as canonical

    return canonical(table(spark, d, "graph_concept").groupBy("prefix", "concept_id").agg(F.max("pref_label").alias("label"), F.max("status").alias("status")))


_CODES = f"q as (select '{_URL}snomed' system, 'snomed' prefix, from_id code from {{similar_snomed_concept}} union select '{_URL}mondo', 'mondo', from_id from {{similar_snomed_concept}} union select 'urn:none', null, from_id from {{similar_snomed_concept}}), c as (select prefix, concept_id, max(pref_label) label, max(status) status from {{graph_concept}} group by 1, 2)"


@query(f"with {_CODES} select system, code, c.concept_id is not null result, c.label display from q left join c on c.prefix = q.prefix and c.concept_id = q.code")
def fhir_validate(spark, d):
    return lookup.validate(_graph_concepts(spark, d), _codes(spark, d), _URL).select("system", "code", "result", "display")


@query(f"with {_CODES} select system, code, c.concept_id is not null ok, cast(case when c.concept_id is null then null else 3 + (c.status is not null)::int + (c.label is not null)::int end as integer) n_parameters from q left join c on c.prefix = q.prefix and c.concept_id = q.code")
def fhir_lookup(spark, d):
    out = lookup.lookup(_graph_concepts(spark, d), _codes(spark, d), _URL)
    return out.select("system", "code", "ok", F.when(F.col("parameters").isNotNull(), F.size("parameters")).alias("n_parameters"))


@query("select event_type, cast(epoch(date_trunc('hour', ts)) as bigint) start_s, count(*) n, round(sum(value), 4) total from {events} group by 1, 2")
def windowed_events(spark, d):
    out = windowed_counts(table(spark, d, "events"))
    return out.select("event_type", F.unix_timestamp("start").alias("start_s"), "n", F.round("total", 4).alias("total"))


@query("""with e as (select user_id, ts, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) < 1800000000 then 0 else 1 end fresh from {events}),
 s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) k from e) select user_id, cast(floor(epoch(min(ts))) as bigint) start_s, count(*) n from s group by user_id, k""")
def event_sessions(spark, d):
    out = sessions(table(spark, d, "events"))
    return out.select("user_id", F.unix_timestamp("start").alias("start_s"), "n")


@query()
def ingest_stream(spark, d):
    """Documents as JSON lines through the streaming upsert; the state after it."""
    base = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    rows = table(spark, d, "documents").select(F.lit("hpo").alias("prefix"), F.col("doc_id").cast("string").alias("concept_id"), F.col("source").alias("label"), F.col("text").alias("definition"))
    rows.write.json(f"{base}/in")
    store = ConceptStore(spark, f"{base}/store")
    ingest(spark, f"{base}/in", store, f"{base}/checkpoint").awaitTermination()
    return store.read().select("concept_id", "label", F.length("definition").alias("n"))
