"""SQL text for the correctness oracle (DuckDB dialect), generated from the same fixed values as the Spark jobs.

Nothing here runs on Spark: these strings are what ``__spark_entry__.oracle_sql`` hands to the checker, which
runs them against the driver's parquet tables registered as views.
"""

from __future__ import annotations

from collections.abc import Sequence

from . import config as C
from .fixtures import N_CLASSES, PHRASES, SCORE_RIGHT_BONUS, SCORE_SCALE
from .plans.cascade import MODEL_WH_PER_KCHAR, SCORER_WH_PER_KCHAR

WS = "[ \\t\\n\\x0B\\f\\r]"
NOT_ALNUM_WS = "[^A-Za-z0-9 \\t\\n\\x0B\\f\\r]"
DIGITS = 9


def q(s: str) -> str:
    """SQL string literal (newlines kept as real characters; quotes doubled)."""
    return "'" + s.replace("'", "''") + "'"


def sql_key(*parts: str) -> str:
    return "(" + " || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"


def sql_h(expr: str, mod: int = 100) -> str:
    return f"((('0x' || substr(md5({expr}), 1, 4))::BIGINT) % {mod})"


def sql_dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def sql_first_line(x: str) -> str:
    return f"split_part({x}, chr(10), 1)"


def sql_concat(*parts: str) -> str:
    # concat with null propagation (DuckDB's concat() skips nulls, || does not)
    return "(" + " || ".join(parts) + ")"


# ---------------------------------------------------------------------------------------------------------------
# prompt tables
# ---------------------------------------------------------------------------------------------------------------


def _template(pieces, *inputs) -> str:
    parts = [q(pieces[0])]
    for i, v in enumerate(inputs):
        parts += [q(pieces[i + 1]), v]
    if len(pieces) > len(inputs) + 1:
        parts.append(q(pieces[len(inputs) + 1]))
    return sql_concat(*parts)


def prompts_sql(dataset: str) -> str:
    if dataset == "boolq":
        return (
            "SELECT d.doc_id AS prompt_id, 'boolq' AS dataset, "
            f"{_template(C.TEMPLATE_BOOLQ, sql_first_line('d.text'), 'd.text')} AS prompt_text, "
            "CAST(l.quality AS INTEGER) AS gold_class, CAST(NULL AS VARCHAR) AS gold_text "
            "FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
        )
    if dataset == "mnli":
        return (
            "SELECT d.doc_id AS prompt_id, 'mnli' AS dataset, "
            f"{_template(C.TEMPLATE_MNLI, 'd.text', sql_first_line('d.text'))} AS prompt_text, "
            "CAST(l.quality + l.toxic AS INTEGER) AS gold_class, CAST(NULL AS VARCHAR) AS gold_text "
            "FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
        )
    if dataset == "cnn_dm":
        return (
            "SELECT d.doc_id AS prompt_id, 'cnn_dm' AS dataset, "
            f"{_template(C.TEMPLATE_CNN, 'd.text')} AS prompt_text, "
            f"CAST(NULL AS INTEGER) AS gold_class, {sql_first_line('d.text')} AS gold_text FROM documents d"
        )
    if dataset == "samsum":
        return (
            f"SELECT pair_id AS prompt_id, 'samsum' AS dataset, {_template(C.TEMPLATE_SAMSUM, 'user_text')} AS prompt_text, "
            f"CAST(NULL AS INTEGER) AS gold_class, assistant_text AS gold_text FROM ({turn_pairs_sql()}) tp"
        )
    raise KeyError(dataset)


def turn_pairs_sql() -> str:
    return (
        f"SELECT CASE WHEN u.conv_id >= u.turn THEN u.conv_id * u.conv_id + u.conv_id + u.turn ELSE u.turn * u.turn + u.conv_id END AS pair_id, u.conv_id, u.text AS user_text, a.text AS assistant_text "
        "FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 "
        "WHERE u.role = 'user' AND a.role = 'assistant'"
    )


# ---------------------------------------------------------------------------------------------------------------
# text helpers and rules
# ---------------------------------------------------------------------------------------------------------------


def sql_has_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def sql_clean_alnum(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, chr(10), ' ', 'g'), '{NOT_ALNUM_WS}', ' ', 'g')"


def sql_first_words(x: str, n: int) -> str:
    return f"array_to_string(list_slice(string_split_regex(regexp_replace({x}, '^{WS}+', ''), '{WS}+'), 1, {n}), ' ')"


def sql_echoes(model: str) -> str:
    return f"(NOT contains({model}, {q(C.NON_ECHO_MARKER)}))"


def sql_strip_echo(resp: str, prompt: str, model: str) -> str:
    return f"(CASE WHEN {sql_echoes(model)} THEN substring({resp}, length({prompt}) + 1) ELSE {resp} END)"


def sql_binary(x: str, words, hit: int) -> str:
    return f"(CASE WHEN {sql_has_any(f'lower({x})', words)} THEN {hit} ELSE {1 - hit} END)"


def sql_rule_boolq(x: str, model: str) -> str:
    cut = sql_first_words(sql_clean_alnum(x), C.BOOLQ_KEEP_WORDS)
    t = f"(CASE WHEN {sql_echoes(model)} THEN {cut} ELSE {x} END)"
    return sql_binary(t, C.BOOLQ_POSITIVE, 1)


def _sql_mnli_classes(low: str) -> str:
    return (
        f"(CASE WHEN {sql_has_any(low, C.MNLI_NEUTRAL)} THEN 1 "
        f"WHEN {sql_has_any(low, C.MNLI_CONTRADICTION)} THEN 2 ELSE 0 END)"
    )


def sql_rule_mnli(x: str, model: str) -> str:
    cleaned = sql_clean_alnum(x)
    cleaned = f"(CASE WHEN contains({model}, {q(C.MNLI_PHI_SMALL)}) THEN {sql_first_words(cleaned, C.MNLI_KEEP_WORDS_PHI_SMALL)} ELSE {cleaned} END)"
    t = f"(CASE WHEN {sql_echoes(model)} THEN {cleaned} ELSE {x} END)"
    return _sql_mnli_classes(f"lower({t})")


def sql_rule_mnli_cascade(x: str, model: str | None = None) -> str:
    return _sql_mnli_classes(f"lower({x})")


SQL_CLASS_RULES = {
    "boolq": sql_rule_boolq,
    "mnli": sql_rule_mnli,
    "qnli": lambda x, m=None: sql_binary(x, C.QNLI_NOT_ENTAIL, 1),
    "wnli": lambda x, m=None: sql_binary(x, C.WNLI_ZERO, 0),
    "cola": lambda x, m=None: sql_binary(x, C.COLA_ZERO, 0),
    "sst2": lambda x, m=None: sql_binary(x, C.SST2_ONE, 1),
    "mrpc": lambda x, m=None: sql_binary(x, C.MRPC_ZERO, 0),
    "copa": lambda x, m=None: sql_binary(x, C.COPA_ZERO, 0),
}
SQL_CASCADE_RULES = {"boolq": sql_rule_boolq, "mnli": sql_rule_mnli_cascade}


def _sql_vector(x: str, groups) -> str:
    return "[" + ", ".join(f"COALESCE(CAST({sql_has_any(x, g)} AS INTEGER), 0)" for g in groups) + "]"


def sql_vax_gold(x: str) -> str:
    return _sql_vector(f"COALESCE({x}, {q(C.VAX_NULL_GOLD)})", [(w,) for w in C.VAX_GOLD_LABELS])


def sql_vax(x: str, m=None) -> str:
    return _sql_vector(f"lower({x})", [(w,) for w in C.VAX_PRED_LABELS])


def sql_caves_gold(x: str) -> str:
    return _sql_vector(x, [(w,) for w in C.CAVES_LABELS])


def sql_caves(x: str, m=None) -> str:
    return _sql_vector(f"lower({x})", [(w,) for w in C.CAVES_LABELS])


def sql_hatex_gold(x: str) -> str:
    return _sql_vector(x, [(w,) for w in C.HATEX_GOLD_LABELS])


def sql_hatex(x: str, m=None) -> str:
    return _sql_vector(f"substring(lower({x}), 1, {C.HATEX_PREFIX_CHARS})", C.HATEX_PRED_LABELS)


def sql_stsb(x: str, m=None) -> str:
    head = f"substring({x}, 1, 3)"
    return (
        f"(CASE WHEN regexp_matches({head}, '^[0-9][.][0-9]') THEN TRY_CAST({head} AS DOUBLE) "
        f"ELSE TRY_CAST(substring({x}, 1, 1) AS DOUBLE) END)"
    )


SQL_MULTILABEL_RULES = {"vax": (sql_vax_gold, sql_vax), "caves": (sql_caves_gold, sql_caves), "hatex": (sql_hatex_gold, sql_hatex)}


# ---------------------------------------------------------------------------------------------------------------
# stub responder and scorer
# ---------------------------------------------------------------------------------------------------------------


def chain_values(chain) -> str:
    rows = ", ".join(f"({t.tier}, {q(t.model)}, {t.skill})" for t in chain)
    return f"(VALUES {rows}) AS ch(tier, model, skill)"


def sql_answer_class(pid: str, gold: str, model: str, skill: str, n: int) -> str:
    right = f"{sql_h(sql_key(pid, q('-a-'), model))} < {skill}"
    wrong = f"(({gold} + 1 + {sql_h(sql_key(pid, q('-w-'), model), max(n - 1, 1))}) % {n})"
    return f"(CASE WHEN {right} THEN {gold} ELSE {wrong} END)"


def sql_phrase(dataset: str, cls: str, pid: str, model: str) -> str:
    table = PHRASES[dataset]
    lit = "[" + ", ".join("[" + ", ".join(q(p) for p in row) + "]" for row in table) + "]"
    pick = f"({sql_h(sql_key(pid, q('-p-'), model), len(table[0]))} + 1)"
    return f"({lit}[{cls} + 1][{pick}])"


def answers_sql(dataset: str, chain) -> str:
    """(prompt_id, tier, model, gold_class, prompt_text, response) for every prompt and tier of ``chain``."""
    n = N_CLASSES[dataset]
    cls = sql_answer_class("p.prompt_id", "p.gold_class", "ch.model", "ch.skill", n)
    text = sql_phrase(dataset, cls, "p.prompt_id", "ch.model")
    resp = f"(CASE WHEN {sql_echoes('ch.model')} THEN p.prompt_text || {text} ELSE {text} END)"
    return (
        f"SELECT p.prompt_id, ch.tier, ch.model, p.gold_class, p.prompt_text, {resp} AS response "
        f"FROM ({prompts_sql(dataset)}) p CROSS JOIN {chain_values(chain)}"
    )


def sql_score(strategy: str, pid: str, model: str, right: str) -> str:
    return (
        f"(CAST({sql_h(sql_key(strategy, q('-s-'), pid, q('-'), model))} + CASE WHEN {right} THEN {SCORE_RIGHT_BONUS} ELSE 0 END AS DOUBLE)"
        f" / {sql_dbl(SCORE_SCALE)})"
    )


def scored_long_sql(dataset: str, strategies: Sequence[str]) -> str:
    """(strategy, prompt_id, tier, n_tiers, model, gold, pred, score) for every strategy, prompt and tier."""
    rule = SQL_CASCADE_RULES[dataset]
    parts = []
    for s in strategies:
        chain = C.CHAINS[C.STRATEGIES[s]]
        pred = rule(sql_strip_echo("a.response", "a.prompt_text", "a.model"), "a.model")
        parts.append(
            f"SELECT {q(s)} AS strategy, a.prompt_id, a.tier, {len(chain)} AS n_tiers, a.model, a.gold_class AS gold, {pred} AS pred "
            f"FROM ({answers_sql(dataset, chain)}) a"
        )
    union = " UNION ALL ".join(parts)
    score = sql_score("x.strategy", "x.prompt_id", "x.model", "x.pred = x.gold")
    return f"SELECT x.*, {score} AS score FROM ({union}) x"


def thresholds_values(thresholds) -> str:
    rows = ", ".join(f"({sql_dbl(t)})" for t in thresholds)
    return f"(VALUES {rows}) AS th(threshold)"


def sweep_final_sql(dataset: str = "boolq", strategies=tuple(C.STRATEGIES), thresholds=C.THRESHOLDS_BOOLQ) -> str:
    """Accepted row per (strategy, threshold, prompt): first tier with score > t, else the last tier."""
    return f"""
    WITH sc AS ({scored_long_sql(dataset, strategies)}),
    grid AS (SELECT sc.*, th.threshold FROM sc CROSS JOIN {thresholds_values(thresholds)}),
    first_acc AS (
      SELECT strategy, threshold, prompt_id,
             min(CASE WHEN score > threshold OR tier = n_tiers THEN tier END) AS acc_tier
      FROM grid GROUP BY strategy, threshold, prompt_id)
    SELECT g.strategy, g.threshold, g.prompt_id, g.tier, g.model, g.gold, g.pred, g.score, g.n_tiers
    FROM grid g JOIN first_acc f
      ON g.strategy = f.strategy AND g.threshold = f.threshold AND g.prompt_id = f.prompt_id AND g.tier = f.acc_tier
    """


def macro_prf_sql(src: str, group_cols: Sequence[str], gold: str = "gold", pred: str = "pred") -> str:
    g = ", ".join(group_cols)
    gsel = (g + ", ") if g else ""
    gby = f"GROUP BY {g}" if g else ""
    return f"""
    WITH src AS (SELECT * FROM ({src}) s),
    r AS (SELECT * FROM src WHERE {gold} IS NOT NULL AND {pred} IS NOT NULL),
    lab AS (SELECT {gsel}{gold} AS label FROM r UNION SELECT {gsel}{pred} AS label FROM r),
    per AS (
      SELECT {', '.join('lab.' + c for c in group_cols) + (', ' if group_cols else '')}lab.label,
        (SELECT count(*) FROM r WHERE r.{gold} = lab.label {''.join(f' AND r.{c} = lab.{c}' for c in group_cols)}) AS ng,
        (SELECT count(*) FROM r WHERE r.{pred} = lab.label {''.join(f' AND r.{c} = lab.{c}' for c in group_cols)}) AS np,
        (SELECT count(*) FROM r WHERE r.{pred} = lab.label AND r.{gold} = lab.label {''.join(f' AND r.{c} = lab.{c}' for c in group_cols)}) AS tp
      FROM lab)
    SELECT {gsel}CAST(sum(ng) AS BIGINT) AS n,
      CAST((SELECT count(*) FROM src WHERE ({gold} IS NULL OR {pred} IS NULL) {''.join(f' AND src.{c} = per.{c}' for c in group_cols)}) AS BIGINT) AS unlabelled,
      round(avg(CASE WHEN np > 0 THEN tp::DOUBLE / np ELSE 0.0 END), {DIGITS}) AS m_pre,
      round(avg(CASE WHEN ng > 0 THEN tp::DOUBLE / ng ELSE 0.0 END), {DIGITS}) AS m_rec,
      round(avg(CASE WHEN ng + np > 0 THEN 2.0 * tp / (ng + np) ELSE 0.0 END), {DIGITS}) AS m_f1
    FROM per {gby}
    """


def macro_prf_multilabel_sql(src: str, group_cols: Sequence[str], gold: str = "gold", pred: str = "pred") -> str:
    g = ", ".join(group_cols)
    gsel = (g + ", ") if g else ""
    return f"""
    WITH r AS (SELECT * FROM ({src}) s),
    ex AS (SELECT *, unnest(generate_series(1, len({gold}))) AS i FROM r),
    pos AS (SELECT {gsel}i, {gold}[i] AS g, {pred}[i] AS p FROM ex),
    per AS (SELECT {gsel}i, sum(g * p) AS tp, sum(g) AS ng, sum(p) AS np, count(*) AS rows FROM pos GROUP BY {gsel}i)
    SELECT {gsel}CAST(max(rows) AS BIGINT) AS n,
      round(avg(CASE WHEN np > 0 THEN tp::DOUBLE / np ELSE 0.0 END), {DIGITS}) AS m_pre,
      round(avg(CASE WHEN ng > 0 THEN tp::DOUBLE / ng ELSE 0.0 END), {DIGITS}) AS m_rec,
      round(avg(CASE WHEN ng + np > 0 THEN 2.0 * tp / (ng + np) ELSE 0.0 END), {DIGITS}) AS m_f1
    FROM per {('GROUP BY ' + g) if g else ''}
    """


def threshold_sweep_sql(dataset="boolq", strategies=tuple(C.STRATEGIES), thresholds=C.THRESHOLDS_BOOLQ) -> str:
    return macro_prf_sql(sweep_final_sql(dataset, strategies, thresholds), ["strategy", "threshold"])


def threshold_sweep_fine_sql() -> str:
    """Every prompt gated at every one of 1,000 thresholds; counts first, then the metrics and the cost of the cells."""
    rate = "CASE " + " ".join(f"WHEN v = {t} THEN {r!r}" for t, r in MODEL_WH_PER_KCHAR.items()) + " ELSE 0.0 END"
    return f"""
    WITH sc AS MATERIALIZED ({scored_long_sql('boolq', tuple(C.STRATEGIES))}),
    th AS (SELECT i / 1000.0::DOUBLE AS threshold FROM range(1000) t(i)),
    acc AS (SELECT strategy, threshold, prompt_id, min(CASE WHEN score > threshold OR tier = n_tiers THEN tier END) AS tier FROM sc CROSS JOIN th GROUP BY ALL),
    cells AS MATERIALIZED (SELECT a.strategy, a.threshold, a.tier, s.n_tiers, s.gold, s.pred, count(*) AS n, sum(length(p.prompt_text)) / 1000.0 AS kchar
      FROM acc a JOIN sc s USING (strategy, prompt_id, tier) JOIN ({prompts_sql('boolq')}) p ON p.prompt_id = a.prompt_id GROUP BY ALL),
    lab AS (SELECT strategy, threshold, gold AS label, n AS ng, 0 AS np, CASE WHEN gold = pred THEN n ELSE 0 END AS tp FROM cells
            UNION ALL SELECT strategy, threshold, pred, 0, n, 0 FROM cells),
    per AS (SELECT strategy, threshold, label, sum(ng) AS ng, sum(np) AS np, sum(tp) AS tp FROM lab GROUP BY ALL),
    q AS (SELECT strategy, threshold, CAST(sum(ng) AS BIGINT) AS n, round(avg(CASE WHEN np > 0 THEN tp / np ELSE 0.0 END), {DIGITS}) AS m_pre,
            round(avg(CASE WHEN ng > 0 THEN tp / ng ELSE 0.0 END), {DIGITS}) AS m_rec, round(avg(2.0 * tp / (ng + np)), {DIGITS}) AS m_f1 FROM per GROUP BY ALL),
    c AS (SELECT strategy, threshold, CAST(sum(calls) AS BIGINT) AS model_calls, round(sum(wh), 6) AS energy_wh FROM (
            SELECT strategy, threshold, tier * n AS calls,
              kchar * list_sum(list_transform(range(1, tier + 1), lambda v: ({rate}) + CASE WHEN v < n_tiers THEN {SCORER_WH_PER_KCHAR!r} ELSE 0.0 END)) AS wh FROM cells) x
          GROUP BY ALL)
    SELECT q.strategy, q.threshold, n, CAST(0 AS BIGINT) AS unlabelled, m_pre, m_rec, m_f1, model_calls, energy_wh FROM q JOIN c USING (strategy, threshold)"""


def cascade_cost_sql(final_sql: str, dataset: str = "boolq") -> str:
    rate = "CASE " + " ".join(f"WHEN v = {t} THEN {r!r}" for t, r in MODEL_WH_PER_KCHAR.items()) + " ELSE 0.0 END"
    return f"""
    WITH f AS ({final_sql}),
    p AS (SELECT prompt_id, length(prompt_text) / 1000.0 AS kchar FROM ({prompts_sql(dataset)}) x),
    v AS (SELECT f.strategy, f.threshold, f.tier, f.n_tiers, p.kchar, gs.v FROM f JOIN p ON f.prompt_id = p.prompt_id,
          generate_series(1, f.tier) gs(v))
    SELECT strategy, threshold, count(*) AS model_calls,
      round(sum(kchar * (({rate}) + CASE WHEN v < n_tiers THEN {SCORER_WH_PER_KCHAR!r} ELSE 0.0 END)), 6) AS energy_wh
    FROM v GROUP BY strategy, threshold
    """


# ---------------------------------------------------------------------------------------------------------------
# evaluation
# ---------------------------------------------------------------------------------------------------------------


def _models_values() -> str:
    rows = ", ".join(f"({q(t.model)}, {t.skill})" for t in C.EVAL_MODELS)
    return f"(VALUES {rows}) AS m(model, skill)"


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else q(v) for v in values) + "]"


def task_rows_sql(tasks) -> str:
    tv = ", ".join(f"({q(t)})" for t in tasks)
    return (
        "SELECT t.task, d.doc_id AS prompt_id, m.model, m.skill, "
        f"(t.task || ': ' || d.text) AS prompt_text, l.quality, l.toxic "
        f"FROM documents d JOIN labels l ON d.doc_id = l.doc_id CROSS JOIN (VALUES {tv}) AS t(task) CROSS JOIN {_models_values()}"
    )


def _eh(tag: str) -> str:
    return f"(('0x' || substr(md5({sql_key('prompt_id', q(tag), 'task', q('/'), 'model')}), 1, 4))::BIGINT)"


def _gh(tag: str) -> str:
    return f"(('0x' || substr(md5({sql_key('prompt_id', q(tag), 'task')}), 1, 4))::BIGINT)"


def _respond_sql(phrase: str) -> str:
    resp = f"(CASE WHEN {sql_echoes('model')} THEN prompt_text || {phrase} ELSE {phrase} END)"
    return sql_strip_echo(resp, "prompt_text", "model")


def class_labelled_sql(tasks) -> str:
    parts = []
    for task in tasks:
        n = 3 if task == "mnli" else 2
        gold = "CAST(quality + toxic AS INTEGER)" if task == "mnli" else "CAST(quality AS INTEGER)"
        cls = f"(CASE WHEN {_eh('-a-')} % 100 < skill THEN {gold} ELSE ({gold} + 1 + {_eh('-w-')} % {n - 1}) % {n} END)"
        table = C.EVAL_CLASS_PHRASES[task]
        lit = "[" + ", ".join(_list(r) for r in table) + "]"
        row = f"{lit}[{cls} + 1]"
        phrase = f"{row}[{_eh('-p-')} % len({row}) + 1]"
        parts.append(
            f"SELECT task, model, prompt_id, {gold} AS gold, {_respond_sql(phrase)} AS answer "
            f"FROM ({task_rows_sql([task])}) r"
        )
    labelled = []
    for task, part in zip(tasks, parts):
        labelled.append(f"SELECT *, {SQL_CLASS_RULES[task]('answer', 'model')} AS pred FROM ({part}) a")
    return " UNION ALL ".join(labelled)


def eval_class_sql(tasks) -> str:
    return macro_prf_sql(class_labelled_sql(tasks), ["task", "model"])


def _pick_sql(values, h: str) -> str:
    return f"{_list(values)}[{h} % {len(values)} + 1]"


def multilabel_labelled_sql(tasks) -> str:
    parts = []
    for task in tasks:
        if task == "vax":
            g = _pick_sql(C.VAX_GOLD_CHOICES, _gh("-g-"))
        elif task == "caves":
            g = f"({_pick_sql(C.CAVES_LABELS, _gh('-g-'))} || ',' || {_pick_sql(C.CAVES_LABELS, _gh('-h-'))})"
        else:
            g = _pick_sql(C.HATEX_GOLD_CHOICES, _gh("-g-"))
        ph = _pick_sql(C.EVAL_MULTILABEL_PHRASES[task], _eh("-p-"))
        gold_fn, pred_fn = SQL_MULTILABEL_RULES[task]
        inner = f"SELECT task, model, prompt_id, {g} AS gold_text, {_respond_sql(ph)} AS answer FROM ({task_rows_sql([task])}) r"
        parts.append(f"SELECT *, {gold_fn('gold_text')} AS gold, {pred_fn('answer')} AS pred FROM ({inner}) a")
    return " UNION ALL ".join(parts)


def eval_multilabel_sql(tasks) -> str:
    return macro_prf_multilabel_sql(multilabel_labelled_sql(tasks), ["task", "model"])


def stsb_labelled_sql() -> str:
    ph = _pick_sql(C.STSB_PHRASES, _eh("-p-"))
    inner = (
        f"SELECT task, model, prompt_id, CAST(quality * 2.5 + toxic AS DOUBLE) AS gold, {_respond_sql(ph)} AS answer "
        f"FROM ({task_rows_sql(['stsb'])}) r"
    )
    return f"SELECT *, {sql_stsb('answer')} AS pred FROM ({inner}) a"


def regression_sql(src: str, group_cols) -> str:
    g = ", ".join(group_cols)
    return f"""
    WITH r AS (SELECT *, CASE WHEN gold IS NOT NULL AND pred IS NOT NULL THEN gold END AS gv FROM ({src}) s),
    s AS (SELECT {g}, count(gv) AS n, count(*) - count(gv) AS unparsed, var_pop(gv) AS vg,
                 sum(CASE WHEN gv IS NOT NULL THEN (gold - pred) * (gold - pred) END) AS see,
                 sum(CASE WHEN gv IS NOT NULL THEN abs(gold - pred) END) AS sae FROM r GROUP BY {g})
    SELECT {g}, n, unparsed, round(sqrt(see / n), 6) AS rmse, round(sae / n, 6) AS mae,
      round(CASE WHEN vg > 0 THEN 1 - see / (n * vg) END, 6) AS r2
    FROM s
    """


def eval_stsb_sql() -> str:
    return regression_sql(stsb_labelled_sql(), ["task", "model"])


def labelled_answers_sql(dataset: str, chain_name: str) -> str:
    ans = sql_strip_echo("a.response", "a.prompt_text", "a.model")
    return (
        f"SELECT a.prompt_id, a.tier, a.model, a.gold_class AS gold, {ans} AS answer, "
        f"{SQL_CASCADE_RULES[dataset](ans, 'a.model')} AS pred FROM ({answers_sql(dataset, C.CHAINS[chain_name])}) a"
    )


def scorer_rows_sql(dataset: str, chains=("flan", "phi"), pct: int | None = None) -> str:
    """(prompt_id, model, tier, stripped, original, y, held) of the scorers' training rows."""
    pct = C.VALIDATION_PCT[dataset] if pct is None else pct
    if dataset == "samsum":
        labels = scorer_labels_text_sql(text_pairs_by_model_sql("samsum", C.CHAINS[chains[0]]))
        src = f"SELECT a.prompt_id, a.model, a.tier, a.response AS stripped, a.response AS original, l.label AS y FROM ({text_answers_sql('samsum', C.CHAINS[chains[0]])}) a JOIN ({labels}) l ON a.prompt_id = l.prompt_id AND a.model = l.model"
    else:
        ans = sql_strip_echo("a.response", "a.prompt_text", "a.model")
        pred = SQL_CASCADE_RULES[dataset](ans, "a.model")
        read = ans if dataset == "boolq" else f"CAST({pred} AS VARCHAR)"
        src = " UNION ALL ".join(
            f"SELECT a.prompt_id, a.model, a.tier, a.prompt_text || {read} AS stripped, a.response AS original, CASE WHEN {pred} = a.gold_class THEN 1 ELSE 0 END AS y FROM ({answers_sql(dataset, C.CHAINS[c])}) a"
            for c in chains
        )
    return f"SELECT x.*, {sql_h(sql_key('prompt_id', q('-split-'), q('42')))} < {pct} AS held FROM ({src}) x"


def scorer_fit_sql(rows: str, scorers, n_features: int, result: str) -> str:
    """Gradient descent of all scorers, epoch by epoch, over (row, feature) pairs; ``result`` reads ``curve`` (sid, strategy, model,
    e, n_train, n_val, train_loss, val_loss, kept), ``logits`` of the kept epoch (sid, rid, z), ``ex`` and ``sc``."""
    last = max(s.epochs for s in scorers)
    cell = lambda x: "NULL" if x is None else q(x)
    values = ", ".join(f"({i}, {q(s.strategy)}, {cell(s.model)}, {s.step!r}::DOUBLE, {s.epochs}, {q(s.kind)})" for i, s in enumerate(scorers))
    kinds = ", ".join(f"({q(k)})" for k in sorted({s.kind for s in scorers}))
    ctes = [
        f"sc AS MATERIALIZED (SELECT * FROM (VALUES {values}) v(sid, strategy, model, step, epochs, kind))",
        f"rw AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM ({rows}) r)",
        f"ex AS MATERIALIZED (SELECT rid, prompt_id, model, tier, y, held, k.kind, {sql_tokens("CASE WHEN k.kind LIKE 'original/%' THEN original ELSE stripped END")} AS t FROM rw CROSS JOIN (VALUES {kinds}) k(kind))",
        f"""bk AS (SELECT rid, kind, (('0x' || substr(md5(token), 1, 8))::BIGINT) % {n_features} AS f, count(*) AS c FROM (
            SELECT rid, kind, unnest(t) AS token FROM ex UNION ALL SELECT rid, kind, unnest({sql_ngrams('t', 2)}) FROM ex WHERE kind LIKE '%/pairs') GROUP BY ALL)""",
        f"""fx AS MATERIALIZED (SELECT rid, kind, f, c / sqrt(sum(c * c) OVER (PARTITION BY rid, kind)) AS x FROM bk UNION ALL SELECT rid, kind, {n_features}, 1.0 FROM ex)""",
        "own AS MATERIALIZED (SELECT sc.sid, ex.rid, ex.kind, ex.y, ex.held FROM ex JOIN sc ON sc.kind = ex.kind AND (sc.model IS NULL OR sc.model = ex.model))",
        "nn AS MATERIALIZED (SELECT sid, count(*) FILTER (NOT held) AS n_train, count(*) FILTER (held) AS n_val FROM own GROUP BY sid)",
        f"w0 AS MATERIALIZED (SELECT sid, f, 0.0::DOUBLE AS w FROM sc CROSS JOIN range({n_features + 1}) t(f))",
    ]
    for e in range(last + 1):
        ctes.append(f"""z{e} AS MATERIALIZED (SELECT o.sid, o.rid, o.kind, o.y, o.held, sum(fx.x * w.w) AS z FROM own o JOIN fx ON fx.rid = o.rid AND fx.kind = o.kind
            JOIN w{e} w ON w.sid = o.sid AND w.f = fx.f GROUP BY ALL)""")
        p = "(1 / (1 + exp(-z)))"
        loss = f"CASE WHEN y = 1 THEN -ln(greatest({p}, 1e-15)) ELSE -ln(greatest(1 - {p}, 1e-15)) END"
        ctes.append(f"l{e} AS MATERIALIZED (SELECT sid, {e} AS e, sum(CASE WHEN NOT held THEN {loss} END) AS tl, sum(CASE WHEN held THEN {loss} END) AS vl FROM z{e} GROUP BY sid)")
        if e < last:
            ctes.append(f"""w{e + 1} AS MATERIALIZED (SELECT w.sid, w.f, w.w - CASE WHEN {e} < sc.epochs THEN sc.step * coalesce(g.g, 0) / nn.n_train ELSE 0 END AS w
                FROM w{e} w JOIN sc ON sc.sid = w.sid JOIN nn ON nn.sid = w.sid LEFT JOIN (
                  SELECT z.sid, fx.f, sum(fx.x * ({p} - z.y)) AS g FROM z{e} z JOIN fx ON fx.rid = z.rid AND fx.kind = z.kind WHERE NOT z.held GROUP BY ALL) g ON g.sid = w.sid AND g.f = w.f)""")
    every = " UNION ALL ".join(f"SELECT * FROM l{e}" for e in range(1, last + 1))
    ctes.append(f"""curve AS MATERIALIZED (SELECT sc.sid, sc.strategy, sc.model, sc.step, sc.kind, x.e, nn.n_train, nn.n_val, x.tl / nn.n_train AS train_loss, x.vl / nn.n_val AS val_loss,
        x.e = arg_min(x.e, (x.vl, x.e)) OVER (PARTITION BY sc.sid) AS kept FROM ({every}) x JOIN sc ON sc.sid = x.sid JOIN nn ON nn.sid = sc.sid WHERE x.e <= sc.epochs)""")
    chosen = " UNION ALL ".join(f"SELECT z.sid, z.rid, z.z FROM z{e} z JOIN curve c ON c.sid = z.sid AND c.e = {e} AND c.kept" for e in range(1, last + 1))
    ctes.append(f"logits AS ({chosen})")
    return f"WITH {', '.join(ctes)} {result}"


# ---------------------------------------------------------------------------------------------------------------
# emission records derived from events
# ---------------------------------------------------------------------------------------------------------------


def batch_records_sql() -> str:
    from .fixtures import RUN_OF_EVENT, RUN_THRESHOLDS, SINGLE_MODEL_RUN
    from .sources.emissions import DATASET

    thr = f"{_list(RUN_THRESHOLDS)}[user_id % {len(RUN_THRESHOLDS)} + 1]"
    cases = " ".join(f"WHEN event_type = {q(e)} THEN {q(n + '-')} || {thr}" for e, n in RUN_OF_EVENT)
    run = f"CASE {cases} ELSE {q(SINGLE_MODEL_RUN)} END"
    return f"""
    SELECT dataset, run, row_number() OVER (PARTITION BY run ORDER BY event_id) - 1 AS batch, event_id, energy_kwh, duration_s
    FROM (SELECT {q(DATASET)} AS dataset, {run} AS run,
                 event_id, value / 1e6 AS energy_kwh, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10.0 AS duration_s
          FROM events) e"""


def emission_records_sql() -> str:
    return f"""
    SELECT dataset || '_' || run || '_' || CAST(batch AS VARCHAR) AS project_name, dataset || '_' || run AS folder, run, batch, event_id, md5(CAST(event_id AS VARCHAR)) AS run_id,
           duration_s AS duration, energy_kwh AS energy_consumed
    FROM ({batch_records_sql()}) b"""


def sql_wh_rounded(x: str) -> str:
    return f"round(CAST({x} * 1000 AS DECIMAL(18,9)), 3)"


def energy_batches_sql() -> str:
    return f"SELECT run, CAST(batch AS BIGINT) AS batch, project_name, {sql_wh_rounded('energy_consumed')} AS energy_wh FROM ({emission_records_sql()}) r"


# ---------------------------------------------------------------------------------------------------------------
# ROUGE and embedding match
# ---------------------------------------------------------------------------------------------------------------


def sql_tokens(x: str) -> str:
    t = f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    return f"(CASE WHEN {t} = '' THEN []::VARCHAR[] ELSE string_split({t}, ' ') END)"


def sql_ngrams(tk: str, n: int) -> str:
    if n == 1:
        return tk
    return f"list_transform(range(1, len({tk}) - {n - 2}), lambda i: array_to_string({tk}[i:i + {n - 1}], ' '))"


def _g(group_cols) -> tuple[str, str, str]:
    """(select prefix, group-by list incl. pair_id, join condition on group cols) for grouped text jobs."""
    pre = "".join(f"{c}, " for c in group_cols)
    cond = "".join(f" AND a.{c} = b.{c}" for c in group_cols)
    return pre, pre + "pair_id", cond


def rouge_n_sql(pairs: str, n: int, group_cols=()) -> str:
    pre, gp, _ = _g(group_cols)
    gb = ", ".join(group_cols)
    return f"""
    WITH pr AS ({pairs}),
    tk AS MATERIALIZED (SELECT {pre}pair_id, 'p' AS side, {sql_tokens('pred')} AS t FROM pr UNION ALL SELECT {pre}pair_id, 'r' AS side, {sql_tokens('ref')} AS t FROM pr),
    g AS (SELECT {pre}pair_id, side, unnest({sql_ngrams('t', n)}) AS gram FROM tk),
    pg AS (SELECT {gp}, gram, sum(CASE WHEN side = 'p' THEN 1 ELSE 0 END) AS pc, sum(CASE WHEN side = 'r' THEN 1 ELSE 0 END) AS rc
           FROM g GROUP BY {gp}, gram),
    pp AS (SELECT {gp}, sum(least(pc, rc)) AS ov, sum(pc) AS np, sum(rc) AS nr FROM pg GROUP BY {gp}),
    fu AS (SELECT pr.*, COALESCE(pp.ov, 0) AS ov, COALESCE(pp.np, 0) AS np, COALESCE(pp.nr, 0) AS nr FROM pr LEFT JOIN pp USING ({gp})),
    sc AS (SELECT *, CASE WHEN np > 0 THEN ov / np ELSE 0.0 END AS p, CASE WHEN nr > 0 THEN ov / nr ELSE 0.0 END AS r FROM fu)
    SELECT {pre}count(*) AS pairs, round(avg(CASE WHEN p + r > 0 THEN 2.0 * p * r / (p + r) ELSE 0.0 END), 9) AS rouge{n}
    FROM sc {('GROUP BY ' + gb) if gb else ''}"""


def _common_prefix_sql(a: str, b: str) -> str:
    """Length of the common prefix of two lists."""
    n = f"least(len({a}), len({b}))"
    return f"COALESCE(list_position(list_transform(range(1, {n} + 1), lambda i: {a}[i] = {b}[i]), false) - 1, {n})"


def rouge_l_sql(pairs: str, group_cols=()) -> str:
    """What two token lists share at both ends is part of a longest common subsequence, so only the rest goes through the
    table: one of its rows per step, of which the last alone is kept. A step takes the next token of the shorter list, and
    the new row is the running maximum of greatest(value above, value above left + equal)."""
    pre, gp, _ = _g(group_cols)
    gb = ", ".join(group_cols)
    return f"""
    WITH RECURSIVE pr AS ({pairs}),
    t0 AS (SELECT *, row_number() OVER () AS id, COALESCE({sql_tokens('pred')}, []) AS pt, COALESCE({sql_tokens('ref')}, []) AS rt FROM pr),
    t1 AS (SELECT *, {_common_prefix_sql('pt', 'rt')} AS head FROM t0),
    t2 AS (SELECT *, list_reverse(pt[head + 1:]) AS pb, list_reverse(rt[head + 1:]) AS rb FROM t1),
    t3 AS (SELECT *, {_common_prefix_sql('pb', 'rb')} AS tail FROM t2),
    tl AS MATERIALIZED (SELECT * EXCLUDE (pb, rb), pb[tail + 1:] AS pm, rb[tail + 1:] AS rm FROM t3),
    two AS MATERIALIZED (SELECT id, CASE WHEN len(pm) < len(rm) THEN pm ELSE rm END AS short, CASE WHEN len(pm) < len(rm) THEN rm ELSE pm END AS long
            FROM tl WHERE len(pm) > 0 AND len(rm) > 0),
    tp AS (SELECT id, unnest(long) AS tok, unnest(generate_series(1, len(long))) AS k FROM two),
    tr AS MATERIALIZED (SELECT id, unnest(short) AS tok, unnest(generate_series(1, len(short))) AS i FROM two),
    step AS (
      SELECT 0 AS i, id, k, tok, 0 AS v, false AS done FROM tp
      UNION ALL
      SELECT i, id, k, tok, CAST(max(best) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS v, done
      FROM (SELECT coalesce(tr.i, s.i) AS i, s.id, s.k, s.tok, tr.i IS NULL AS done,
                   greatest(s.v, CASE WHEN tr.i IS NULL THEN 0 ELSE lag(s.v, 1, 0) OVER (PARTITION BY s.id ORDER BY s.k) + CASE WHEN s.tok = tr.tok THEN 1 ELSE 0 END END) AS best
            FROM step s LEFT JOIN tr ON s.id = tr.id AND tr.i = s.i + 1 WHERE NOT s.done) x
    ),
    lcs AS (SELECT s.id, max(s.v) AS v FROM step s WHERE s.done GROUP BY s.id),
    sh AS (SELECT tl.*, head + tail + COALESCE(lcs.v, 0) AS v FROM tl LEFT JOIN lcs ON lcs.id = tl.id),
    sc AS (SELECT *, CASE WHEN len(pt) > 0 THEN v / len(pt) ELSE 0.0 END AS p, CASE WHEN len(rt) > 0 THEN v / len(rt) ELSE 0.0 END AS r FROM sh)
    SELECT {pre}count(*) AS pairs, round(avg(CASE WHEN p + r > 0 THEN 2.0 * p * r / (p + r) ELSE 0.0 END), 9) AS "rougeL"
    FROM sc {('GROUP BY ' + gb) if gb else ''}"""


def embed_match_per_pair_sql(pairs: str, group_cols=()) -> str:
    pre, gp, cond = _g(group_cols)
    return f"""
    WITH pr AS ({pairs}),
    tk AS (SELECT {pre}pair_id, 'p' AS side, unnest({sql_tokens('pred')}) AS token FROM pr
           UNION ALL SELECT {pre}pair_id, 'r' AS side, unnest({sql_tokens('ref')}) AS token FROM pr),
    cnt AS (SELECT {gp}, side, token, count(*) AS cnt FROM tk GROUP BY {gp}, side, token),
    nv AS (SELECT max(vec_id) + 1 AS n FROM embeddings),
    lost AS (SELECT {gp}, sum(c.cnt) AS no_vector FROM cnt c CROSS JOIN nv LEFT JOIN embeddings e ON e.vec_id = ((('0x' || substr(md5(c.token), 1, 8))::BIGINT) % nv.n)
             WHERE e.vec_id IS NULL GROUP BY {gp}),
    vec AS (SELECT c.*, e.embedding::DOUBLE[] AS v FROM cnt c CROSS JOIN nv
            JOIN embeddings e ON e.vec_id = ((('0x' || substr(md5(c.token), 1, 8))::BIGINT) % nv.n)),
    sim AS (SELECT {''.join('a.' + c + ', ' for c in group_cols)}a.pair_id, a.side, a.token, a.cnt, max(list_cosine_similarity(a.v, b.v)) AS m
            FROM vec a JOIN vec b ON a.pair_id = b.pair_id{cond} AND a.side <> b.side
            GROUP BY {''.join('a.' + c + ', ' for c in group_cols)}a.pair_id, a.side, a.token, a.cnt),
    ss AS (SELECT {gp}, side, sum(cnt * m) / sum(cnt) AS s FROM sim GROUP BY {gp}, side),
    pp AS (SELECT {''.join('pr.' + c + ', ' for c in group_cols)}pr.pair_id, COALESCE(sp.s, 0.0) AS p, COALESCE(sr.s, 0.0) AS r, COALESCE(lo.no_vector, 0) AS no_vector FROM pr
           LEFT JOIN lost lo ON lo.pair_id = pr.pair_id{''.join(f' AND lo.{c} = pr.{c}' for c in group_cols)}
           LEFT JOIN ss sp ON sp.pair_id = pr.pair_id AND sp.side = 'p'{''.join(f' AND sp.{c} = pr.{c}' for c in group_cols)}
           LEFT JOIN ss sr ON sr.pair_id = pr.pair_id AND sr.side = 'r'{''.join(f' AND sr.{c} = pr.{c}' for c in group_cols)})
    SELECT *, CASE WHEN p + r > 0 THEN 2.0 * p * r / (p + r) ELSE 0.0 END AS f FROM pp"""


def embed_match_sql(pairs: str, group_cols=()) -> str:
    pre = "".join(f"{c}, " for c in group_cols)
    gb = ", ".join(group_cols)
    return f"""SELECT {pre}count(*) AS pairs, round(avg(p), 9) AS emb_p, round(avg(r), 9) AS emb_r, round(avg(f), 9) AS emb_f1, CAST(sum(no_vector) AS BIGINT) AS no_vector
    FROM ({embed_match_per_pair_sql(pairs, group_cols)}) x {('GROUP BY ' + gb) if gb else ''}"""


def conversation_pairs_sql() -> str:
    return f"SELECT pair_id, assistant_text AS pred, user_text AS ref FROM ({turn_pairs_sql()}) t"


def task_prompts_sql(task: str) -> str:
    if task == "cnn_dm":
        return (
            f"SELECT p.prompt_id, p.prompt_text, p.gold_text, d.text AS source_text FROM ({prompts_sql('cnn_dm')}) p "
            "JOIN documents d ON d.doc_id = p.prompt_id"
        )
    prompt = _template(C.TEMPLATE_SAMSUM, "user_text") if task == "samsum" else "user_text"
    return f"SELECT pair_id AS prompt_id, {prompt} AS prompt_text, assistant_text AS gold_text, user_text AS source_text FROM ({turn_pairs_sql()}) t"


def text_answers_sql(task: str, models=C.EVAL_MODELS) -> str:
    mv = ", ".join(f"({q(t.model)}, {t.skill}, {t.tier})" for t in models)
    right = f"(((('0x' || substr(md5({sql_key('p.prompt_id', q('-a-'), q(task), q('/'), 'm.model')}), 1, 4))::BIGINT) % 100) < m.skill)"
    text = f"(CASE WHEN {right} THEN p.gold_text ELSE p.source_text END)"
    resp = f"(CASE WHEN {sql_echoes('m.model')} THEN p.prompt_text || {text} ELSE {text} END)"
    return (
        f"SELECT p.prompt_id, m.model, m.tier, lower(p.gold_text) AS gold_text, lower({sql_strip_echo(resp, 'p.prompt_text', 'm.model')}) AS answer, "
        f"{right} AS \"right\", {resp} AS response FROM ({task_prompts_sql(task)}) p CROSS JOIN (VALUES {mv}) AS m(model, skill, tier)"
    )


def text_pairs_by_model_sql(task: str, models=C.EVAL_MODELS) -> str:
    return f"SELECT model, prompt_id AS pair_id, answer AS pred, gold_text AS ref FROM ({text_answers_sql(task, models)}) a"


def text_metrics_sql(pairs: str, keys) -> str:
    on = lambda t: " AND ".join(f"e.{k} = {t}.{k}" for k in keys)
    return f"""SELECT {', '.join('e.' + k for k in keys)}, e.pairs, r1.rouge1, r2.rouge2, rl."rougeL", e.emb_p, e.emb_r, e.emb_f1, e.no_vector
    FROM ({embed_match_sql(pairs, keys)}) e JOIN ({rouge_n_sql(pairs, 1, keys)}) r1 ON {on('r1')}
    JOIN ({rouge_n_sql(pairs, 2, keys)}) r2 ON {on('r2')} JOIN ({rouge_l_sql(pairs, keys)}) rl ON {on('rl')}"""


def eval_text_sql(task: str) -> str:
    return text_metrics_sql(text_pairs_by_model_sql(task), ["model"])


def eval_all_sql(class_tasks, multilabel_tasks, text_tasks, class_sql: str | None = None) -> str:
    """(task, model, metric, value) of all tasks."""
    prf = ("n", "unlabelled", "m_pre", "m_rec", "m_f1")
    text = ("pairs", "rouge1", "rouge2", "rougeL", "emb_p", "emb_r", "emb_f1", "no_vector")
    sources = [
        (class_sql or eval_class_sql(class_tasks), prf), (eval_multilabel_sql(multilabel_tasks), ("n", "m_pre", "m_rec", "m_f1")),
        (eval_stsb_sql(), ("n", "unparsed", "rmse", "mae", "r2")),
        *((f"SELECT {q(t)} AS task, * FROM ({eval_text_sql(t)}) x", text) for t in text_tasks),
    ]
    parts = []
    for sql, names in sources:
        lists = "[" + ", ".join(q(n) for n in names) + "]", "[" + ", ".join(f'CAST("{n}" AS DOUBLE)' for n in names) + "]"
        parts.append(f"SELECT task, model, unnest({lists[0]}) AS metric, unnest({lists[1]}) AS value FROM ({sql}) s")
    return " UNION ALL ".join(parts)


def eval_run_folder_sql(class_tasks, multilabel_tasks, text_tasks, missing: tuple[str, str], short: tuple[str, str]) -> str:
    """All tasks without the run that is missing and the second half, by prompt length, of the one that is short."""
    is_run = lambda r: f"(x.task = {q(r[0])} AND x.model = {q(r[1])})"
    place = f"""SELECT d.doc_id AS prompt_id, row_number() OVER (ORDER BY length({q(short[0] + ': ')} || d.text), d.doc_id) <= count(*) OVER () // 2 AS said
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""
    labelled = f"SELECT x.* FROM ({class_labelled_sql(class_tasks)}) x JOIN ({place}) y ON x.prompt_id = y.prompt_id WHERE NOT {is_run(missing)} AND (y.said OR NOT {is_run(short)})"
    metrics = eval_all_sql(class_tasks, multilabel_tasks, text_tasks, macro_prf_sql(labelled, ["task", "model"]))
    sizes = [f"SELECT {q(t)} AS task, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id" for t in (*class_tasks, *multilabel_tasks, "stsb")]
    sizes += [f"SELECT {q(t)}, count(*) FROM ({task_prompts_sql(t)}) p" for t in text_tasks]
    runs = f"SELECT s.task, m.model, s.n FROM ({' UNION ALL '.join(sizes)}) s CROSS JOIN {_models_values()}"
    said = f"CASE WHEN {is_run(missing)} THEN 0 WHEN {is_run(short)} THEN n // 2 ELSE n END"
    return f"""{metrics} UNION ALL SELECT task, model, 'references' AS metric, CAST(n AS DOUBLE) AS value FROM ({runs}) x
    UNION ALL SELECT task, model, 'answers', CAST({said} AS DOUBLE) FROM ({runs}) x"""


def scorer_labels_text_sql(pairs: str | None = None) -> str:
    from .config import SCORER_LABEL_MIN_F1

    per = embed_match_per_pair_sql(pairs or text_pairs_by_model_sql("samsum"), ["model"])
    return f"SELECT model, pair_id AS prompt_id, round(f, 9) AS emb_f1, CAST(CASE WHEN f > {SCORER_LABEL_MIN_F1} THEN 1 ELSE 0 END AS BIGINT) AS label FROM ({per}) x"


def cascade_text_sql(strategy: str = "strategy-9", thresholds=C.THRESHOLDS_SAMSUM) -> str:
    chain = C.CHAINS[C.STRATEGIES[strategy]]
    last = max(t.tier for t in chain)
    a = text_answers_sql("samsum", chain)
    score = sql_score(q(strategy), "a.prompt_id", "a.model", 'a."right"')
    grid = f"SELECT a.*, {score} AS score, th.threshold FROM ({a}) a CROSS JOIN {thresholds_values(thresholds)}"
    pairs = f"""WITH gr AS ({grid}),
      acc AS (SELECT threshold, prompt_id, min(CASE WHEN score > threshold OR tier = {last} THEN tier END) AS tier FROM gr GROUP BY threshold, prompt_id)
      SELECT {q(strategy)} AS strategy, gr.threshold, gr.prompt_id AS pair_id, gr.answer AS pred, gr.gold_text AS ref
      FROM gr JOIN acc ON gr.threshold = acc.threshold AND gr.prompt_id = acc.prompt_id AND gr.tier = acc.tier"""
    return text_metrics_sql(pairs, ["strategy", "threshold"])


# ---------------------------------------------------------------------------------------------------------------
# run outputs
# ---------------------------------------------------------------------------------------------------------------


def batch_plan_sql(dataset: str = "boolq", bs: int = 4) -> str:
    return f"""
    SELECT dataset, prompt_id, CAST(length(prompt_text) AS BIGINT) AS n_chars,
      row_number() OVER (PARTITION BY dataset ORDER BY length(prompt_text), prompt_id) AS position,
      CAST((row_number() OVER (PARTITION BY dataset ORDER BY length(prompt_text), prompt_id) - 1) // {bs} AS BIGINT) AS batch_id
    FROM ({prompts_sql(dataset)}) p"""


def batch_times_sql(plan: str) -> str:
    from .fixtures import STEP_S, T0

    start = f"({sql_dbl(T0)} + batch_id * {sql_dbl(STEP_S)})"
    return (
        f"SELECT batch_id, {start} AS start_ts, {start} + {sql_dbl(0.5)} + max(n_chars) / {sql_dbl(1000.0)} AS end_ts "
        f"FROM ({plan}) pl GROUP BY batch_id"
    )


def run_answers_sql(bs: int = 4) -> str:
    """(model, prompt_id, position, batch_id, response) for every model of both chains over the boolq batch plan."""
    ans = " UNION ALL ".join(f"SELECT * FROM ({answers_sql('boolq', C.CHAINS[c])}) a{i}" for i, c in enumerate(("flan", "phi")))
    return f"SELECT a.model, a.prompt_id, pl.position, pl.batch_id, a.response FROM ({ans}) a JOIN ({batch_plan_sql('boolq', bs)}) pl ON a.prompt_id = pl.prompt_id"


# ---------------------------------------------------------------------------------------------------------------
# results and curves
# ---------------------------------------------------------------------------------------------------------------


def sql_pct1(x: str) -> str:
    return f"CAST(round(CAST({x} * 100 AS DECIMAL(18,6)), 1) AS DOUBLE)"


def quality_rows_sql(sweep: str) -> str:
    return (
        f'SELECT strategy AS "Model", threshold AS "Threshold", {sql_pct1("m_pre")} AS "M-Pre", {sql_pct1("m_rec")} AS "M-Rec", '
        f'{sql_pct1("m_f1")} AS "M-F1" FROM ({sweep}) s'
    )


def baselines_sql(dataset: str = "boolq", chains=("flan", "phi")) -> str:
    lab = " UNION ALL ".join(f"SELECT {q(ch)} AS chain, * FROM ({labelled_answers_sql(dataset, ch)}) x{i}" for i, ch in enumerate(chains))
    rate = "CASE " + " ".join(f"WHEN l.tier = {t} THEN {r!r}" for t, r in MODEL_WH_PER_KCHAR.items()) + " ELSE 0.0 END"
    return f"""
    WITH lab AS ({lab}),
    f1 AS ({macro_prf_sql('SELECT * FROM lab', ['chain', 'model', 'tier'])}),
    p AS (SELECT prompt_id, length(prompt_text) / 1000.0 AS kchar FROM ({prompts_sql(dataset)}) x),
    cost AS (SELECT l.chain, l.model, l.tier, round(sum(p.kchar * ({rate})), 6) AS energy_wh FROM lab l JOIN p ON l.prompt_id = p.prompt_id
             GROUP BY l.chain, l.model, l.tier)
    SELECT f1.chain, f1.model, CAST(f1.tier AS BIGINT) AS tier, f1.m_f1, cost.energy_wh FROM f1 JOIN cost
      ON f1.chain = cost.chain AND f1.model = cost.model AND f1.tier = cost.tier"""


def measured_energy_sql() -> str:
    return f"""SELECT strategy, threshold, CAST(sum(energy_wh) AS DOUBLE) AS measured_wh
    FROM (SELECT {run_parts_sql()}, {sql_wh_rounded('energy_consumed')} AS energy_wh FROM ({emission_records_sql()}) r) b GROUP BY strategy, threshold"""


def sweep_points_sql() -> str:
    return f"""SELECT s.strategy, s.threshold, s.m_f1, c.energy_wh FROM ({threshold_sweep_sql()}) s
          JOIN ({cascade_cost_sql(sweep_final_sql())}) c ON s.strategy = c.strategy AND s.threshold = c.threshold"""


def cost_quality_sql() -> str:
    return f"""
    WITH m AS ({measured_energy_sql()}),
    q AS ({sweep_points_sql()})
    SELECT 'cascade' AS kind, COALESCE(q.strategy, e.strategy) AS strategy, COALESCE(q.threshold, e.threshold) AS threshold, q.m_f1, q.energy_wh, e.measured_wh
    FROM q FULL OUTER JOIN (SELECT * FROM m WHERE threshold IS NOT NULL) e ON q.strategy = e.strategy AND q.threshold = e.threshold
    UNION ALL
    SELECT 'single' AS kind, COALESCE(b.model, e.strategy) AS strategy, th.threshold, b.m_f1, b.energy_wh, e.measured_wh
    FROM ({baselines_sql()}) b FULL OUTER JOIN (SELECT * FROM m WHERE threshold IS NULL) e ON b.model = e.strategy
    CROSS JOIN {thresholds_values(C.THRESHOLDS_BOOLQ)}"""


def batch_inference_sql(dataset: str, chain, batch_size: int) -> str:
    """What the blind pandas stub answers, with the batch of every prompt."""
    cls = sql_h(sql_key("p.prompt_id", q("-b-"), "ch.model"), N_CLASSES[dataset])
    text = sql_phrase(dataset, cls, "p.prompt_id", "ch.model")
    resp = f"(CASE WHEN {sql_echoes('ch.model')} THEN p.prompt_text || {text} ELSE {text} END)"
    return f"""SELECT p.prompt_id, CAST(ch.tier AS BIGINT) AS tier, ch.model, pl.batch_id, {resp} AS response
    FROM ({prompts_sql(dataset)}) p CROSS JOIN {chain_values(chain)} JOIN ({batch_plan_sql(dataset, batch_size)}) pl ON p.prompt_id = pl.prompt_id"""


def run_parts_sql(name: str = "project_name") -> str:
    """run, batch, strategy and threshold of a project name of the known data set."""
    from .sources.emissions import DATASET

    rest = f"substring({name}, {len(DATASET) + 2})"
    run = f"regexp_extract({rest}, '^(.*)_[^_]*$', 1)"
    threshold = f"TRY_CAST(split_part({run}, '-', -1) AS DOUBLE)"
    return (
        f"{run} AS run, TRY_CAST(split_part({name}, '_', -1) AS BIGINT) AS batch, "
        f"CASE WHEN {threshold} IS NULL THEN {run} ELSE regexp_extract({run}, '^(.*)-[^-]*$', 1) END AS strategy, {threshold} AS threshold"
    )
