"""Label texts, cues, views and votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from benchspark.functions import labels as L
from benchspark.functions import prompts as P
from benchspark.functions.text import WS, WS_CHARS
from benchspark.operators import views
from benchspark.plans import bindings as b
from benchspark.plans.bindings import word_list, words_sql
from benchspark.plans.registry import query


def regex_list(values) -> str:
    return "|".join(sorted(values, key=lambda v: (-len(v), v)))


# --- the rules as SQL ----------------------------------------------------------------------------------------------

def clean_sql(x: str, n: int, name: str) -> str:
    """Columns ``name`` and helpers for clean_label of ``x``."""
    return f"""string_split({b.strip_sql(x)}, chr(10))[-1] AS {name}_line,
  {words_sql(f"regexp_replace(regexp_replace({name}_line, '[()\\[\\]{{}}]', ' ', 'g'), '[^A-Za-z0-9\\-{WS_CHARS}]', '', 'g')")} AS {name}_w,
  array_to_string({name}_w[1:{n}], ' ') AS {name}_s,
  CASE WHEN {name}_s <> '' AND NOT regexp_matches(lower({name}_s), '{regex_list(L.VAGUE_PHRASES)}')
    AND lower({name}_s) NOT IN ({word_list(L.BAD_OBJECTS + L.BAD_GENERIC_PHRASES)})
    AND NOT list_has_any(string_split(lower({name}_s), ' '), [{word_list(L.BAD_GENERIC_WORDS)}]) THEN {name}_s END AS {name}"""


def generic_sql(x: str) -> str:
    w = words_sql(f"lower({x})")
    return f"""coalesce(trim(lower({x})) IN ('', {word_list(L.BAD_OBJECTS + L.BAD_GENERIC_PHRASES + L.FURNITURE_PHRASES)})
  OR coalesce({w}[1] IN ({word_list(L.HUMAN_FIRST)}), false)
  OR (len({w}) <= 2 AND list_has_any({w}, [{word_list(L.BAD_GENERIC_WORDS)}])), true)"""


def bleeding_sql(x: str) -> str:
    low = f"trim(lower({x}))"
    return f"coalesce(contains({low}, ' or ') OR contains({low}, ' and ') OR {low} LIKE '% on', false)"


def ambiguous_sql(x: str) -> str:
    return f"({generic_sql(x)} OR {bleeding_sql(x)})"


def cut_sql(x: str) -> str:
    return f"""CASE WHEN strpos(lower({x}), ' or ') > 0 THEN trim(substr({x}, 1, strpos(lower({x}), ' or ') - 1))
  WHEN strpos(lower({x}), ' and ') > 0 THEN trim(substr({x}, 1, strpos(lower({x}), ' and ') - 1)) ELSE {x} END"""


def sanitize_sql(x: str, name: str) -> str:
    return f"""{cut_sql(x)} AS {name}_cut,
  list_filter(list_transform(string_split({name}_cut, ' on '), lambda p: trim(p)), lambda p: p <> '') AS {name}_p,
  CASE WHEN NOT contains(lower({name}_cut), ' on ') OR len({name}_p) <= 2 THEN {name}_cut ELSE {name}_p[1] || ' on ' || {name}_p[2] END AS {name}_q,
  nullif(regexp_replace(array_to_string({words_sql(f'{name}_q')}, ' '), '(?i)(?:(?:^| )(?:{regex_list(L.PREPOSITIONS)}))+$', ''), '') AS {name}"""


def filter_sql(x: str) -> str:
    return f"CASE WHEN NOT regexp_matches(lower({x}), '{regex_list(L.OVERLAY_WORDS)}') THEN nullif({x}, '') END"


def subset_sql(x: str, y: str) -> str:
    wx, wy = words_sql(f"lower({cut_sql(x)})"), words_sql(f"lower({cut_sql(y)})")
    return f"""coalesce({x} <> '' AND {y} <> '' AND NOT contains(lower({x}), ' on ') AND NOT contains(lower({y}), ' on ')
  AND len({wx}) > 0 AND len({wy}) > 0 AND (list_has_all({wx}, {wy}) OR list_has_all({wy}, {wx})), false)"""


def root_sql(x: str) -> str:
    return f"nullif(trim(string_split({x}, ' on ')[1]), '')"


def relaxed_sql(x: str, y: str, name: str) -> str:
    """``x`` and ``y`` are sanitised columns."""
    return f"""{root_sql(x)} AS {name}_rx, {root_sql(y)} AS {name}_ry,
  coalesce({x} = {y} OR {subset_sql(x, y)} OR {name}_rx = {name}_ry OR {subset_sql(f'{name}_rx', f'{name}_ry')}, false) AS {name}"""


def specificity_sql(x: str) -> str:
    return f"""CASE WHEN {x} <> '' THEN len({words_sql(x)}) - CASE WHEN {generic_sql(x)} THEN 2.0 ELSE 0.0 END
  + CASE WHEN contains(lower({x}), ' on ') THEN 0.5 ELSE 0.0 END ELSE -1.0 END::DOUBLE"""


# --- texts ---------------------------------------------------------------------------------------------------------

def texts(spark, sf):
    """Part names dressed up in nine ways, beside the bare noun and the neighbour's cue."""
    p = b.parts(spark, sf)
    k, name = F.col("p_partkey") % 9, F.col("p_name")
    a = (
        F.when(k == 1, F.concat(name, F.lit(" and box")))
        .when(k == 2, F.concat(name, F.lit(" on Table on floor")))
        .when(k == 3, F.concat(F.lit("the "), name, F.lit(" of by")))
        .when(k == 4, F.concat(name, F.lit(" and cup or box")))
        .when(k == 5, F.concat(F.lit("  "), F.upper(name), F.lit(" ")))
        .when(k == 6, F.when(F.col("p_size") % 2 == 0, "red object").otherwise("gray sofa"))
        .when(k == 7, F.concat(F.lit("man holding "), name))
        .when(k == 8, F.when(F.col("p_size") % 2 == 0, "").otherwise("desk on"))
        .otherwise(name)
    )
    cue = F.when(F.col("p_size") % 3 == 0, F.concat(name, F.lit(" on desk"))).when(F.col("p_size") % 3 == 1, F.substring_index(name, " ", -1))
    return p.select(
        F.col("p_partkey").alias("pos"), a.alias("a"), F.substring_index("p_name", " ", -1).alias("noun"), name.alias("name"),
        cue.alias("cue"), (F.col("p_size") / 1000).alias("area"), F.col("p_size").alias("size"),
    )


TEXTS = """SELECT p_partkey AS pos, CASE p_partkey % 9 WHEN 1 THEN p_name || ' and box' WHEN 2 THEN p_name || ' on Table on floor'
  WHEN 3 THEN 'the ' || p_name || ' of by' WHEN 4 THEN p_name || ' and cup or box' WHEN 5 THEN '  ' || upper(p_name) || ' '
  WHEN 6 THEN CASE WHEN p_size % 2 = 0 THEN 'red object' ELSE 'gray sofa' END WHEN 7 THEN 'man holding ' || p_name
  WHEN 8 THEN CASE WHEN p_size % 2 = 0 THEN '' ELSE 'desk on' END ELSE p_name END AS a, split_part(p_name, ' ', 2) AS noun, p_name AS name,
  CASE WHEN p_size % 3 = 0 THEN p_name || ' on desk' WHEN p_size % 3 = 1 THEN split_part(p_name, ' ', 2) END AS cue, p_size / 1000 AS area, p_size AS size
  FROM part"""
b.CTES["texts"] = TEXTS
SANE = f"SELECT *, {sanitize_sql('a', 'sa')}, {sanitize_sql('cue', 'sc')}, {sanitize_sql('noun', 'sn')} FROM texts"


@query(
    f"""SELECT doc_id, c8 AS clean, CASE WHEN c4 IS NULL THEN NULL WHEN NOT list_has_any(string_split(lower(c4), ' '), [{word_list(L.COPULAS)}]) THEN c4
  WHEN lower(string_split(c4, ' ')[1]) = 'the' THEN CASE WHEN NOT list_has_any(string_split(lower(r4), ' '), [{word_list(L.COPULAS)}]) THEN r4 END END AS strict,
  nullif(array_to_string(string_split(c10, ' ')[1:least(4, coalesce(nullif(list_position(list_transform(string_split(c10, ' '),
   lambda t: lower(t) IN ({word_list(L.BAD_NOUN_TOKENS)})), true), 0), 99) - 1)], ' '), '') AS salvaged
FROM (SELECT *, {clean_sql("array_to_string(string_split(c4, ' ')[2:], ' ')", 4, 'r4')} FROM
 (SELECT doc_id, {clean_sql('text', 8, 'c8')}, {clean_sql('text', 4, 'c4')}, {clean_sql('text', 10, 'c10')} FROM documents))"""
)
def clean_labels(spark, sf):
    return b.table(spark, sf, "documents").select(
        "doc_id", L.clean_label("text", 8).alias("clean"), L.strict_noun_phrase("text", 4).alias("strict"), L.salvage("text", 4).alias("salvaged")
    )


@query(
    f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({b.strip_sql('text')}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)),
  lambda p: {b.strip_sql('p')}), lambda p: p <> '') AS p FROM documents)
SELECT doc_id, array_to_string(p[1:2], ' ') AS two FROM s"""
)
def first_sentences(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", L.first_two_sentences("text").alias("two"))


@query(
    f"""SELECT pos, sa AS sane, {filter_sql('a')} AS shown, {filter_sql('a').replace(regex_list(L.OVERLAY_WORDS), chr(92) + 'b(?:' + regex_list(L.OVERLAY_WORDS) + ')' + chr(92) + 'b')} AS shown_strict,
  {generic_sql('a')} AS generic, {bleeding_sql('a')} AS bleeding, {ambiguous_sql('a')} AS ambiguous,
  coalesce(regexp_matches(lower(a), '\\b({regex_list(L.PERSON_LIKE)})\\b'), false) AS person_like,
  coalesce(list_has_any({words_sql('lower(a)')}, [{word_list(L.SURFACES)}]), false) AS surface, {specificity_sql('a')} AS specificity
FROM ({SANE})""",
    ("texts",),
)
def label_rules(spark, sf):
    return texts(spark, sf).select(
        "pos", L.sanitize("a").alias("sane"), L.filter_phrase("a").alias("shown"), L.filter_phrase("a", strict=True).alias("shown_strict"),
        L.is_generic("a").alias("generic"), L.is_bleeding("a").alias("bleeding"), L.is_ambiguous("a").alias("ambiguous"),
        L.is_person_like("a").alias("person_like"), L.is_surface("a").alias("surface"), L.specificity("a").alias("specificity"),
    )


@query(
    f"""SELECT pos, {subset_sql('a', 'noun')} AS subset, rel AS relaxed, equ AS equivalent FROM (SELECT *, {relaxed_sql('sa', 'sc', 'rel')},
  coalesce(rel OR (rel_rx <> '' AND rel_ry <> '' AND {subset_sql('rel_rx', 'rel_ry')}), false) AS equ FROM ({SANE}))""",
    ("texts",),
)
def label_match(spark, sf):
    """No name holds an alias, so equivalence is the match of whole labels or of their roots."""
    return texts(spark, sf).select(
        "pos", L.subset_match("a", "noun").alias("subset"), L.relaxed_match("a", "cue").alias("relaxed"), L.equivalent("a", "cue").alias("equivalent")
    )


@query(
    f"""WITH s AS (SELECT *, {relaxed_sql('sc', 'sn', 'dr')} FROM ({SANE})), t AS (SELECT *,
  coalesce(area <= 0.01 AND a <> '' AND cue <> '' AND a <> cue AND ({generic_sql('a')} OR {bleeding_sql('a')}
   OR (contains(lower(cue), ' on ') AND dr) OR (contains(lower(cue), ' on ') AND list_has_any({words_sql('lower(a)')}, [{word_list(L.SURFACES)}]))), false) AS skip FROM s),
u AS (SELECT *, CASE WHEN NOT skip AND NOT {ambiguous_sql('a')} THEN sa END AS by_mask,
  CASE WHEN coalesce(sc IS NOT NULL AND NOT {ambiguous_sql('sc')} AND (skip OR {ambiguous_sql('sa')}) AND (dr OR {subset_sql('sc', 'sn')}), false) THEN sc END AS by_dot FROM t)
SELECT pos, skip AS small_skip, coalesce(by_mask, by_dot, noun) AS label, CASE WHEN coalesce(by_mask, by_dot) IS NULL THEN 'fallback_ray_only'
  ELSE CASE WHEN by_mask IS NOT NULL THEN 'mask_primary' ELSE 'dot_tiebreak_ray' END || CASE WHEN skip THEN '+mask_small_skip' ELSE '' END END AS mode,
  (CASE WHEN coalesce(sn = sc OR {subset_sql('sn', 'sc')}, false) THEN 1 ELSE 0 END + CASE WHEN coalesce(sn = name OR {subset_sql('sn', 'name')}, false) THEN 1 ELSE 0 END) AS cue_hits,
  CASE WHEN NOT {generic_sql('a')} THEN a WHEN NOT {generic_sql('cue')} THEN cue ELSE noun END AS preferred
FROM u""",
    ("texts",),
)
def cue_choice(spark, sf):
    """The dressed name is the mask cue, ``cue`` the dot, the noun the ray."""
    t = texts(spark, sf).withColumn("c", L.canonicalize("a", "cue", "area", "noun"))
    return t.select(
        "pos", F.col("c.small_skip").alias("small_skip"), F.col("c.label").alias("label"), F.col("c.mode").alias("mode"),
        L.cue_agreement("noun", "cue", "name").alias("cue_hits"), L.prefer_specific("a", "cue", "noun", "name")["label"].alias("preferred"),
    )


@query(
    f"""SELECT pos, CASE WHEN area > 0.018 THEN coalesce(sa, sc) WHEN {subset_sql('sa', 'sc')} THEN sa
  WHEN ssa IS NULL THEN ssc WHEN ssc IS NULL THEN ssa
  WHEN {specificity_sql('ssa')} > {specificity_sql('ssc')} THEN ssa WHEN {specificity_sql('ssc')} > {specificity_sql('ssa')} THEN ssc
  WHEN length(ssc) > length(ssa) THEN ssc ELSE ssa END AS mask_label,
  CASE WHEN small <> surface THEN {filter_sql("small || ' on ' || surface")} END AS positional,
  CASE WHEN contains(sc, ' on ') AND NOT size % 2 = 0 AND NOT {generic_sql(root_sql('sc'))} THEN {root_sql('sc')} ELSE sc END AS repaired
FROM (SELECT *, {sanitize_sql('sa', 'ssa')}, {sanitize_sql('sc', 'ssc')}, {clean_sql('name', 3, 'small')}, {clean_sql("CASE WHEN size % 4 = 0 THEN name ELSE 'desk' END", 3, 'surface')} FROM ({SANE}))""",
    ("texts",),
)
def label_repair(spark, sf):
    t = texts(spark, sf)
    surface = F.when(F.col("size") % 4 == 0, F.col("name")).otherwise("desk")
    return t.select(
        "pos", L.choose_mask_label("a", "cue", "area").alias("mask_label"), L.positional("name", surface).alias("positional"),
        L.repair_label("cue", "name", "noun", F.col("size") % 2 == 0).alias("repaired"),
    )


@query(
    f"""WITH s AS (SELECT *, {filter_sql('sa')} AS fa, {filter_sql('sc')} AS fc, {filter_sql('sn')} AS fn FROM ({SANE})),
r AS (SELECT *, {relaxed_sql('fa', 'fc', 'ac')}, {relaxed_sql('fa', 'fn', 'an')}, {relaxed_sql('fc', 'fn', 'cn')}, {generic_sql('fa')} AS ga, {generic_sql('fc')} AS gc, {generic_sql('fn')} AS gn FROM s),
d AS (SELECT *, (NOT ga AND NOT gc AND NOT ac) OR (NOT ga AND NOT gn AND NOT an) OR (NOT gc AND NOT gn AND NOT cn) AS dis FROM r)
SELECT pos, CAST((fa IS NOT NULL)::INT + (fc IS NOT NULL)::INT + (fn IS NOT NULL)::INT AS INTEGER) AS cues, dis AS disagreement,
  CASE WHEN {ambiguous_sql('sa')} THEN 'current_ambiguous' WHEN dis THEN 'cue_disagreement' ELSE 'no_trigger' END AS reason FROM d""",
    ("texts",),
)
def label_maps(spark, sf):
    cues = F.map_from_arrays(F.array(F.lit("mask"), F.lit("dot"), F.lit("ray")), F.array("a", "cue", "noun"))
    t = texts(spark, sf).withColumn("m", L.informative(cues)).withColumn("disagreement", L.disagreement(F.col("m")))
    return t.select("pos", F.size("m").alias("cues"), "disagreement", L.trigger("a", "disagreement").alias("reason"))


@query(
    """SELECT pos, CASE WHEN noun IS DISTINCT FROM name THEN 1 ELSE 0 END + CASE WHEN sc IS DISTINCT FROM sn THEN 1 ELSE 0 END AS steps,
  CASE WHEN sc IS DISTINCT FROM sn THEN CASE WHEN size % 3 = 0 THEN name || ' on desk' WHEN size % 3 = 1 THEN noun END WHEN noun IS DISTINCT FROM name THEN name END AS first_after FROM (""" + SANE + ")",
    ("texts",),
)
def label_changes(spark, sf):
    flow = L.label_flow([("cue", "noun", "cue", "name"), ("same", "noun", "noun", None), ("name", "noun", "name", None)])
    t = texts(spark, sf).withColumn("f", flow)
    return t.select("pos", F.size("f").alias("steps"), F.get("f", F.lit(0))["after"].alias("first_after"))


@query(
    """SELECT pos, CASE WHEN size % 5 = 0 THEN 'person' ELSE noun || ' shirt' || CASE WHEN size % 2 = 0 THEN ' and jeans' ELSE '' END
    || CASE WHEN size % 7 = 0 THEN ' red hat' ELSE '' END END AS cleaned,
  CASE WHEN size % 5 = 0 THEN 'the person' ELSE 'the person wearing ' || CASE WHEN size % 3 = 0 THEN 'is wearing ' ELSE '' END || noun || ' shirt' || CASE WHEN size % 2 = 0 AND size % 7 = 0 THEN ', and jeans, and red hat'
    WHEN size % 2 = 0 THEN ' and and jeans' WHEN size % 7 = 0 THEN ' and red hat' ELSE '' END END AS ref FROM texts""",
    ("texts",),
)
def person_texts(spark, sf):
    size = F.col("size")
    desc = F.when(size % 5 == 0, "A person").otherwise(
        F.concat(
            F.lit("The Man "), F.when(size % 3 == 0, "is wearing ").otherwise("with "), F.col("noun"), F.lit(" shirt"),
            F.when(size % 2 == 0, " and jeans").otherwise(""), F.when(size % 7 == 0, " red hat").otherwise(""),
        )
    )
    # a person reference does not take "is" off the front of "wearing"
    return texts(spark, sf).select("pos", L.clean_person(desc).alias("cleaned"), L.person_ref(desc).alias("ref"))


@query(
    """SELECT pos, 'Using all camera views, what is ' || who || ' looking at?' AS q1,
  'The gaze target is ''' || lower(name) || '''. For each camera view, is it visible to ' || who || '? Answer YES/NO per view.' AS q3,
  'In Cam2, can ' || who || ' see the ''' || name || ''' from their line of sight? Answer YES or NO and explain briefly using front/behind/occlusion.' AS q4
FROM (SELECT *, CASE WHEN size % 5 = 0 THEN 'the person' ELSE 'the person wearing ' || noun || ' coat' END AS who FROM texts)""",
    ("texts",),
)
def questions(spark, sf):
    who = F.when(F.col("size") % 5 == 0, "").otherwise(F.concat(F.lit("a person wearing "), F.col("noun"), F.lit(" coat")))
    t = texts(spark, sf).withColumn("person", who)
    return t.select(
        "pos", P.task1_question("person").alias("q1"), P.task3_question("person", "name").alias("q3"),
        P.task4_question(F.lit("Cam2"), "name", "person").alias("q4"),
    )


@query(
    f"""SELECT idx, md5('Image order and camera IDs:' || chr(10) || '- Image 1: Cam' || (k % 6 + 1) || ' (frame ' || frame || ')' || chr(10)
  || '- Image 2: Cam' || ((k + 100) % 6 + 1) || ' (frame ' || frame || ')' || chr(10) || chr(10) || 'Task type: ' || task_type || chr(10)
  || 'Question: ' || q || chr(10) || chr(10) || 'Respond in no more than three sentences.') AS prompt_md5
FROM (SELECT *, idx % 300 AS k FROM frozen) WHERE q <> ''""",
    b.FREEZING[:5],
)
def inference_prompts(spark, sf):
    from benchspark.plans.freezing import manifest

    return manifest(spark, sf).where("question <> ''").select("idx", F.md5(P.inference_prompt()).alias("prompt_md5"))


JUDGE_HEAD_SQL = P.JUDGE_HEAD.replace("'", "''").replace("\n", "' || chr(10) || '")


@query(
    f"""SELECT sample_uid, model_key, pos, md5('{JUDGE_HEAD_SQL}' || 'Task type: ' || task_type || chr(10) || 'Question: ' || question || chr(10)
  || 'Groundtruth answer: ' || groundtruth_answer || chr(10) || 'Model answer: ' || inference_answer || chr(10) || 'Your verdict:') AS prompt_md5
FROM eval_rows""",
    b.SCORING,
)
def judge_prompts(spark, sf):
    from benchspark.operators.campaign import judge_input

    rows = judge_input(b.manifest(spark, sf), b.predictions(spark, sf))
    return rows.select("sample_uid", "model_key", "pos", F.md5(P.judge_prompt()).alias("prompt_md5"))


@query(
    """WITH r AS (SELECT pos, cam, 'In ' || cam || ', ' AS h, CASE WHEN cx IS NOT NULL THEN format('gaze point ({:.1f}, {:.1f})', cx, cy) ELSE 'gaze point' END AS g,
  CASE WHEN pos % 10 <> 0 THEN format('mask area ratio={:.4f}', area) ELSE 'mask area ratio=N/A' END AS m, coalesce(bw > 1, false) AS ray, label, mask_label AS anchor FROM cams)
SELECT pos, CASE WHEN anchor <> label AND ray THEN h || 'the ' || g || ' falls on the segmented mask labeled ''' || anchor || '''. Across visible cameras, the majority label is ''' || label || '''. ' || m || '.'
  WHEN anchor <> label THEN h || 'no valid person bbox is available for a gaze ray, so labeling uses dot/mask evidence. The segmented mask is ''' || anchor || ''', and cross-view synthesis selects ''' || label || '''. ' || m || '.'
  WHEN ray THEN h || 'the ' || g || ' falls on the segmented mask labeled ''' || label || '''. The gaze ray from head/eye aligns with that region, and the label is assigned from the mask. ' || m || '.'
  ELSE h || 'no valid person bbox is available for a gaze ray, so labeling uses dot/mask evidence around the gaze point for ''' || label || '''. ' || m || '.' END AS reasoning FROM r""",
    ("cams",),
)
def gaze_reasoning(spark, sf):
    from benchspark.functions.geometry import at, valid_box

    c = b.frame_cams(spark, sf).withColumns(
        {"x": at("coord", 0), "y": at("coord", 1), "ray": valid_box("body"), "area": F.when(F.col("pos") % 10 != 0, F.col("mask_area_ratio"))}
    )
    return c.select("pos", P.task1_reasoning("cam", "x", "y", "area", "mask_label", "label", "ray").alias("reasoning"))


# --- views ---------------------------------------------------------------------------------------------------------

def view_rows(spark, sf):
    """Six neighbouring parts are the views of one frame; the fourth camera is the anchor of every third frame."""
    anchor = F.when(F.floor(F.col("pos") / 6) % 3 == 0, "Cam4").otherwise("Cam1")
    return views.one_view_per_camera(b.camera_rows(spark, sf).withColumn("anchor_cam", anchor))


VIEWS = """v AS (SELECT *, CASE WHEN f % 3 = 0 THEN 'Cam4' ELSE 'Cam1' END AS anchor FROM cams),
near AS (SELECT frame_key, arg_min(cam, (dist, cam <> anchor, cam_pos)) AS closest FROM v GROUP BY 1),
w AS (SELECT v.*, closest, CASE WHEN cam = anchor THEN 2.0 ELSE 1.0 END * CASE WHEN cam = closest AND dist <= 0.2 THEN 0.8 ELSE 1.0 END AS weight FROM v JOIN near USING (frame_key))"""


@query(f"WITH {VIEWS} SELECT frame_key, cam, closest AS closest_cam, weight::DOUBLE AS weight FROM w", ("cams",))
def view_weights(spark, sf):
    return views.camera_weights(view_rows(spark, sf)).select("frame_key", "cam", "closest_cam", "weight")


def _assign_sql() -> str:
    """First-fit clusters of up to six ordered labels: the place of the first earlier cluster head that matches."""
    steps, inner = [], "packed"
    for i in range(1, 7):
        cases = " ".join(f"WHEN a{j} = {j} AND m(l[{i}], l[{j}]) THEN {j}" for j in range(1, i))
        body = f"CASE WHEN len(l) < {i} THEN NULL {cases} ELSE {i} END" if i > 1 else "1"
        steps.append(f"s{i} AS (SELECT *, {body} AS a{i} FROM {inner})")
        inner = f"s{i}"
    text = ",\n".join(steps)
    import re

    return re.sub(r"m\((l\[\d\]), (l\[\d\])\)", lambda g: "(" + subset_sql(g.group(1), g.group(2)) + ")", text)


@query(
    f"""WITH {VIEWS},
packed AS (SELECT frame_key, list(label ORDER BY cam <> anchor, cam_pos) AS l, list(weight ORDER BY cam <> anchor, cam_pos) AS wt FROM w WHERE label <> '' GROUP BY 1),
{_assign_sql()},
long AS (SELECT frame_key, len(l) AS n, unnest(l) AS lab, unnest(wt) AS weight, unnest([a1, a2, a3, a4, a5, a6][1:len(l)]) AS cl, unnest(range(len(l))) AS i FROM s6),
spec AS (SELECT *, {sanitize_sql('lab', 'san')}, {specificity_sql('san')} AS sp FROM long),
cl AS (SELECT frame_key, n, cl, round(sum(weight), 6) AS weight, arg_max(san, (sp, length(san), -i)) AS cand, max(sp) AS sp FROM spec GROUP BY 1, 2, 3)
SELECT frame_key, arg_max(cand, (weight, sp, -cl)) AS mv_label, CASE WHEN n = 1 THEN 'mv_single' ELSE 'mv_weighted' END AS mv_mode, CAST(n AS INTEGER) AS mv_views,
  CASE WHEN n > 1 THEN max(weight)::DOUBLE END AS mv_weight FROM cl GROUP BY frame_key, n""",
    ("cams",),
)
def view_vote(spark, sf):
    return views.multiview_vote(views.camera_weights(view_rows(spark, sf)))


@query(
    f"""WITH {VIEWS}, j AS (SELECT *, noun AS canon FROM v),
g AS (SELECT frame_key, max(canon) FILTER (WHERE cam = 'Cam2') AS canon FROM j GROUP BY 1),
k AS (SELECT v.*, g.canon, {subset_sql('label', 'g.canon')} OR label = g.canon AS ok FROM v JOIN g USING (frame_key)),
s AS (SELECT frame_key, any_value(canon) AS mv, max(label) FILTER (WHERE cam = anchor) AS al, max(mode) FILTER (WHERE cam = anchor) AS am,
  bool_or(ok) FILTER (WHERE cam = anchor) AS am_ok, count(*) FILTER (WHERE cam <> anchor AND ok) AS agree,
  count(*) FILTER (WHERE cam <> anchor AND ok AND mode <> 'mask_small_skip') AS strong FROM k GROUP BY 1),
t AS (SELECT *, NOT {ambiguous_sql('al')} AND am <> 'mask_small_skip' AS locked FROM s)
SELECT frame_key, CASE WHEN mv IS NULL THEN 'mv_missing' WHEN al IS NULL THEN 'no_anchor' WHEN am_ok THEN 'anchor_match'
  WHEN NOT locked AND agree >= 1 THEN 'anchor_uncertain_mv_support' WHEN NOT locked THEN 'anchor_uncertain_no_support'
  WHEN strong >= 2 THEN 'mv_strong_consensus' ELSE 'mv_consensus_weak' END AS override_reason FROM t""",
    ("cams",),
)
def vote_override(spark, sf):
    """The second camera's noun stands for the vote."""
    v = view_rows(spark, sf)
    voted = v.where("cam = 'Cam2'").select("frame_key", F.col("mask_label").alias("mv_label"))
    return views.override_decision(v, voted).select("frame_key", "override_reason")


@query(
    f"""WITH {VIEWS}, g AS (SELECT frame_key, max(noun) AS canon FROM v GROUP BY 1),
k AS (SELECT v.*, canon, {subset_sql('label', 'canon')} OR label = canon AS ok, (CASE WHEN {subset_sql('mask_label', 'canon')} OR mask_label = canon THEN 1 ELSE 0 END
  + CASE WHEN {subset_sql('ray_label', 'canon')} OR ray_label = canon THEN 1 ELSE 0 END) / 2 AS cue FROM v JOIN g USING (frame_key)),
s AS (SELECT frame_key, any_value(canon) AS canon, count(*) AS n, count(*) FILTER (WHERE ok) AS agree, max(area) FILTER (WHERE cam = anchor) AS area,
  coalesce(max(cue) FILTER (WHERE cam = anchor), 0) AS cue, max(CASE WHEN visible THEN 'YES' ELSE 'NO' END) AS pose FROM k GROUP BY 1),
p AS (SELECT *, agree / n AS consensus, least(1, greatest(0, ({specificity_sql('canon')} + 1.5) / 6)) AS spec,
  CASE WHEN area IS NULL THEN 0.5 WHEN area BETWEEN 0.000001 AND 0.65 THEN 1 WHEN area < 0.000001 THEN area / 0.000001 ELSE 0.65 / area END AS mq, least(1, n / 2) AS vf FROM s)
SELECT frame_key, round(consensus, 9) AS consensus, round(spec, 9) AS specificity, round(mq::DOUBLE, 9) AS mask_quality, round(cue, 9) AS cue_agreement,
  round((0.45::DOUBLE * consensus + 0.25::DOUBLE * spec + 0.2::DOUBLE * mq + 0.1::DOUBLE * cue) * vf * CASE WHEN pose = 'NO' THEN 0.6::DOUBLE ELSE 1 END, 9) AS confidence FROM p""",
    ("cams",),
)
def view_confidence(spark, sf):
    """The greatest noun of a frame stands for its label; a frame nobody sees fails the pose check."""
    v = view_rows(spark, sf)
    canon = v.groupBy("frame_key").agg(F.max("mask_label").alias("canonical"))
    rows = v.join(canon, "frame_key").withColumn("pose", F.when(F.col("visible"), "YES").otherwise("NO"))
    c = views.confidence(rows, pose="pose")
    parts = ["consensus", "specificity", "mask_quality", "cue_agreement", "confidence"]
    return c.select("frame_key", *[F.round(p, 9).alias(p) for p in parts])


def attempt_rows(spark, sf):
    """Four neighbouring parts are the attempts of one camera: two loose ones, a relaxed and a strict one."""
    p = b.parts(spark, sf)
    k = F.col("p_partkey")
    stage = F.when(k % 4 == 0, "loose").when(k % 4 == 1, "loose2").when(k % 4 == 2, "relaxed").otherwise("strict")
    noun = F.substring_index("p_name", " ", -1)
    label = F.when(k % 5 == 0, noun).when(k % 7 == 0, "thing").when(k % 11 == 0, F.lit(None)).otherwise(F.col("p_name"))
    return p.select(
        F.floor(k / 4).cast("string").alias("frame_key"), F.lit("Cam1").alias("cam"), stage.alias("stage"), (k % 4).cast("int").alias("stage_pos"),
        label.alias("label"), F.lit("m").alias("mode"), (F.col("p_size") / 500).alias("mask_area_ratio"), (F.col("p_size") % 3).cast("int").alias("cue_hits"),
    )


ATTEMPTS = """x AS (SELECT p_partkey // 4 AS f, p_partkey % 4 AS s, p_size / 500 AS area, p_size % 3 AS hits,
  CASE WHEN p_partkey % 5 = 0 THEN split_part(p_name, ' ', 2) WHEN p_partkey % 7 = 0 THEN 'thing' WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name END AS lab FROM part),
g AS (SELECT f, max(s) AS smax, max(area) FILTER (WHERE s = 0) AS a0, max(lab) FILTER (WHERE s = 0) AS l0, max(area) FILTER (WHERE s = 1) AS a1, max(lab) FILTER (WHERE s = 1) AS l1,
  max(area) FILTER (WHERE s = 2) AS a2, max(lab) FILTER (WHERE s = 2) AS l2, max(hits) FILTER (WHERE s = 2) AS h2, max(lab) FILTER (WHERE s = 3) AS l3 FROM x GROUP BY 1)"""


def _bad(x: str) -> str:
    return f"coalesce({x} = 'thing', true)"


def _spec(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN -1 WHEN {x} = 'thing' THEN -1 ELSE len(string_split({x}, ' ')) END"


@query(
    f"""WITH {ATTEMPTS}, base AS (SELECT *, CASE WHEN smax = 0 THEN 0 WHEN {_bad('l0')} AND NOT {_bad('l1')} THEN 1 WHEN {_bad('l1')} AND NOT {_bad('l0')} THEN 0
  WHEN a1 > a0 * 1.05 THEN 1 WHEN a0 > a1 * 1.05 THEN 0 WHEN {_spec('l1')} > {_spec('l0')} THEN 1 ELSE 0 END AS bi FROM g),
b2 AS (SELECT *, CASE WHEN bi = 1 THEN l1 ELSE l0 END AS bl FROM base),
c AS (SELECT *, CASE WHEN smax >= 2 AND a2 >= 0.0314 AND h2 > 0 AND coalesce(l2 <> 'thing', true) THEN 'relaxed'
  WHEN smax = 3 AND l3 IS NOT NULL AND (bl IS NULL OR l3 = bl OR (l3 <> 'thing' AND ({subset_sql('l3', 'bl')} OR {_spec('l3')} >= {_spec('bl')} + 0.7))) THEN 'strict'
  WHEN smax = 3 THEN 'base' END AS pick FROM b2)
SELECT CAST(f AS VARCHAR) AS frame_key,
  CASE WHEN pick = 'relaxed' AND l2 IS NOT NULL THEN 'relaxed' WHEN pick = 'strict' THEN 'strict' WHEN bi = 1 THEN 'loose2' ELSE 'loose' END AS stage,
  CASE WHEN pick = 'relaxed' AND l2 IS NOT NULL THEN l2 WHEN pick = 'strict' THEN l3 ELSE bl END AS label,
  CASE WHEN pick = 'base' AND bl IS NOT NULL THEN 'm+prefer_loose_baseline' ELSE 'm' END AS mode FROM c"""
)
def attempt_choice(spark, sf):
    return views.select_attempt(attempt_rows(spark, sf)).select("frame_key", "stage", "label", "mode")


@query(
    f"""WITH r AS (SELECT *, CASE WHEN size % 4 = 0 THEN NULL ELSE cue END AS dot, CASE WHEN size % 3 = 0 THEN 'small cup' END AS same_mr,
  CASE WHEN size % 5 = 0 THEN 'gray cup' WHEN size % 5 = 1 THEN 'tall jar' END AS same_md, nullif(a, '') AS m FROM texts)
SELECT pos, CASE WHEN m IS NULL AND dot IS NULL THEN noun WHEN m IS NOT NULL AND same_mr IS NOT NULL THEN same_mr
  WHEN m IS NOT NULL AND dot IS NOT NULL AND size % 5 = 1 THEN same_md WHEN m IS NOT NULL AND dot IS NOT NULL THEN 'big lamp' ELSE coalesce(m, noun) END AS label,
  CASE WHEN m IS NULL AND dot IS NULL THEN 'fallback_single' WHEN m IS NOT NULL AND same_mr IS NOT NULL THEN 'judge_mask_ray'
  WHEN m IS NOT NULL AND dot IS NOT NULL AND size % 5 = 1 THEN 'judge_mask_dot' WHEN m IS NOT NULL AND dot IS NOT NULL THEN 'judge_reconcile_all'
  ELSE 'fallback_no_consensus' END AS mode FROM r""",
    ("texts",),
)
def triple_cues(spark, sf):
    """The dressed name is the mask cue, the noun the ray; the size gives the recorded answers ("gray" holds "ray", so
    that one does not count)."""
    size = F.col("size")
    dot = F.when(size % 4 != 0, F.col("cue"))
    same_mr = F.when(size % 3 == 0, "small cup")
    same_md = F.when(size % 5 == 0, "gray cup").when(size % 5 == 1, "tall jar")
    none = F.lit(None).cast("string")
    t = texts(spark, sf).select("pos", L.triple_cue("noun", "a", dot, same_mr, same_md, none, F.lit("big lamp")).alias("c"))
    return t.select("pos", "c.label", "c.mode")
