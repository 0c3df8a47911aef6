"""The queries in SQL for DuckDB, written apart from the DataFrame code.

DuckDB's classes and word ends are ASCII, so words are spelled as letters,
digits and underscores of all scripts, and a word end as a captured neighbour;
what that consumes is made up for by applying a replacement twice.
"""

from __future__ import annotations

from vestry import fixed
from vestry.functions.extract import ALL_FIELDS, FIELDS
from vestry.operators.assist import SALVAGED
from vestry.plans import fixtures as fx

W = r"[\p{L}\p{N}_]"
N = r"[^\p{L}\p{N}_]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rep(t: str, pattern: str, new: str) -> str:
    return f"regexp_replace({t}, {q(pattern)}, {q(new)}, 'g')"


def lst(items) -> str:
    return "[" + ", ".join(q(str(x)) for x in items) + "]"


def look(d: dict, key: str) -> str:
    return f"({lst(d.values())})[list_position({lst(d)}, {key})]"


def strip(t: str) -> str:
    return rep(t, r"^\s+|\s+$", "")


def words(t: str) -> str:
    return f"list_filter(string_split_regex({strip(t)}, '\\s+'), lambda zz: zz <> '')"


# Cleanup


def hyphens(t):
    return rep(rep(t, rf"({W}+)-\s*\n\s*({W}+)", r"\1\2"), rf"({W}{{1,2}}-\s+{W}+)|({W}{{3,}})-\s+({W}+)", r"\1\2\3")


def abbreviations(t):
    for i, (short, full) in enumerate(fixed.ABBREVIATIONS):
        for _ in range(2):
            if i == 12:
                t = rep(t, rf"(^|{N})у\.({W})", rf"\1{full} \2")
            else:
                t = rep(t, rf"(^|{N}){short}\.\s", rf"\1{full} ")
    return t


def ocr(t):
    for wrong, right in fixed.OCR_REPAIRS:
        t = rep(t, wrong, right)
    for old, new in fixed.OLD_LETTERS.items():
        t = f"replace({t}, {q(old)}, {q(new)})"
    t = rep(t, rf"({W}+)ъ({N}|$)", r"\1\2")
    return rep(rep(rep(t, r"\s+\.", "."), r"\.\s+\.", "."), r"\s{2,}", " ")


def spelling(t):
    d = fixed.SPELLING
    edges = "".join("\\" + c for c in fixed.WORD_EDGES)
    clean = f"list_transform({words(t)}, lambda w: {{'w': w, 'c': {rep('w', f'^[{edges}]+|[{edges}]+$', '')}}})"
    found = f"list_transform({clean}, lambda p: {{'w': p.w, 'c': p.c, 'f': {look(d, 'lower(p.c)')}}})"
    cased = """case when p.f is null then p.c when p.f <> lower(p.f) then p.f
        when p.c = upper(p.c[1]) || lower(p.c[2:]) then upper(p.f[1]) || p.f[2:] when p.c = upper(p.c) then upper(p.f) else p.f end"""
    return f"array_to_string(list_transform({found}, lambda p: {cased} || substring(p.w, length(p.c) + 1)), ' ')"


MONTHS = "|".join(fixed.MONTHS_GENITIVE)
ROMAN = r"(\d{1,2})\s*[.\s]\s*(I{1,3}|IV|V|VI{0,3}|IX|X[I]?)\s*[.\s]\s*(\d{4})"


def dates(t):
    t = f"regexp_replace({t}, {q(rf'(\d{{1,2}})\s+({MONTHS})\s+(\d{{4}})(?:\s+года)?')}, '\\1 \\2 \\3', 'gi')"
    t = rep(t, ROMAN, "\\1.\x01\\2\x01.\\3")
    for n, r in enumerate(fixed.ROMAN_MONTHS, 1):
        t = f"replace({t}, {q(f'\x01{r}\x01')}, {q(f'{n:02d}')})"
    return t


def squeeze(t):
    return strip(rep(t, r"\s+", " "))


def wrap(t, width=80):
    fold = f"""list_reduce(list_prepend({{'done': '', 'now': '', 'size': 0}}, list_transform({words('line')}, lambda w: {{'done': '', 'now': w, 'size': 0}})),
      lambda a, x: case when a.now <> '' and a.size + length(x.now) + 1 > {width}
        then {{'done': a.done || a.now || chr(10), 'now': x.now, 'size': cast(length(x.now) as int)}}
        else {{'done': a.done, 'now': case when a.now = '' then x.now else a.now || ' ' || x.now end, 'size': cast(a.size + length(x.now) + 1 as int)}} end)"""
    lines = f"""list_transform(string_split({t}, chr(10)), lambda line: case when length(line) <= {width} then line
      else list_extract(list_transform([{fold}], lambda r: r.done || r.now), 1) end)"""
    return f"array_to_string({lines}, chr(10))"


STEPS = [hyphens, abbreviations, ocr, spelling, dates, squeeze]
LABELS = ["hyphenated_words_merged", "abbreviations_expanded", "common_ocr_fixes", "spelling_correction", "date_normalization", "whitespace_cleanup"]


def ctes(*parts: tuple[str, str]) -> str:
    return "with " + ",\n".join(f"{name} as ({sql})" for name, sql in parts) + "\n"


TEXT = ("metrical_text", fx.METRICAL_TEXT)
CLEAN = [TEXT, ("s0", "select rec_id, kind, raw_text as t from metrical_text")]
for _k, _step in enumerate(STEPS, 1):
    CLEAN.append((f"s{_k}", f"select *, {_step('t' if _k == 1 else f't{_k - 1}')} as t{_k} from s{_k - 1}"))
CLEAN.append(("cleaned", f"select *, {wrap('t6')} as corrected_text from s6"))


def step(n):
    return ctes(*CLEAN[: n + 2]) + f"select rec_id, t{n} as text from s{n}"


# Extraction


def score(t, kind):
    return " + ".join(f"case when contains(lower({t}), {q(w)}) then {n} else 0 end" for w, n in fixed.RECORD_KEYWORDS[kind])


def date(t):
    def part(p, k):
        return f"regexp_extract({t}, {q(p)}, {k}, 'i')"

    def two(x):
        return f"lpad({x}, 2, '0')"

    months = {m: n for n, m in enumerate(fixed.MONTHS_GENITIVE, 1)} | fixed.MONTHS_OLD
    romans = {r: n for n, r in enumerate(fixed.ROMAN_MONTHS, 1)}
    ru = rf"(\d{{1,2}})\s+({MONTHS})\s+(\d{{4}})"
    old = rf"(\d{{1,2}})\s+({'|'.join(months)})\s+(\d{{4}})"
    num = r"(\d{1,2})[./-](\d{1,2})[./-](\d{4})"
    iso = r"(\d{4})-(\d{2})-(\d{2})"
    out = "case"
    for p in (ru, old):
        out += f" when {part(p, 0)} <> '' then {part(p, 3)} || '-' || {two(look(months, f'lower({part(p, 2)})'))} || '-' || {two(part(p, 1))}"
    out += f" when {part(ROMAN, 0)} <> '' then {part(ROMAN, 3)} || '-' || {two(look(romans, f'upper({part(ROMAN, 2)})'))} || '-' || {two(part(ROMAN, 1))}"
    out += f" when {part(num, 0)} <> '' then {part(num, 3)} || '-' || {two(part(num, 2))} || '-' || {two(part(num, 1))}"
    return out + f" when {part(iso, 0)} <> '' then {part(iso, 0)} else 'Unknown' end"


def name(t, kw):
    after = strip(f"substring({t}, strpos(lower({t}), {q(kw)}) + {len(kw)})")
    found = f"array_to_string(list_slice({words(f'regexp_extract({after}, {q(chr(94) + "([А-Яа-яЁё" + chr(92) + "s" + chr(92) + "-]+)")}, 1)')}, 1, 3), ' ')"
    return f"case when strpos(lower({t}), {q(kw)}) > 0 then coalesce(nullif({found}, ''), 'Unknown') else 'Unknown' end"


def known(*names):
    return "coalesce(" + ", ".join(f"nullif({n}, 'Unknown')" for n in names) + ", 'Unknown')"


T = "corrected_text"
VALUES = {
    "child_name": known(*[name(T, k) for k in ("родился", "родилась", "сын", "дочь", "род")]),
    "father_name": known(name(T, "отец"), f"case when not starts_with(lower({name(T, 'от')}), 'ец') then {name(T, 'от')} end"),
    "mother_name": known(name(T, "мать"), f"case when length({name(T, 'мат')}) >= 3 then {name(T, 'мат')} end"),
    "deceased_name": known(name(T, "умер"), name(T, "скончался")),
    "groom_name": known(name(T, "жених"), name(T, "венчался")),
    "bride_name": known(name(T, "невеста"), name(T, "венчалась")),
    **{f: date(T) for f in ("birth_date", "death_date", "marriage_date")},
    **{f: "'Unknown'" for f in ("baptism_date", "burial_date")},
}
CONFIDENCE = {n: c for fields in FIELDS.values() for n, _, c in fields}


def mean(kind):
    names = [n for n, _, _ in FIELDS[kind]]
    total = "0.0::double" + "".join(f" + case when {n} <> 'Unknown' then {CONFIDENCE[n]}::double else 0.0::double end" for n in names)
    m = f"({total}) / {len(names)}"
    if kind == "death":
        m = f"case when age is null then {m} else ({total} + 0.7::double) / {len(names) + 1} end"
    return f"case when {m} = 0.175::double then 0.17::double else round({m}, 2) end"


EXTRACTED = [
    *CLEAN,
    ("scored", f"select *, {', '.join(f'{score(T, k)} as {k}' for k in FIELDS)} from cleaned"),
    (
        "typed",
        "select *, case when greatest(birth, death, marriage) <= 0 then 'unknown' when birth >= death and birth >= marriage then 'birth' when death >= marriage then 'death' else 'marriage' end as record_type from scored",
    ),
    (
        "valued",
        "select *, "
        + ", ".join(f"case when record_type = '{k}' then {VALUES[n]} end as {n}" for k, fields in FIELDS.items() for n, _, _ in fields)
        + f", case when record_type = 'death' then nullif(regexp_extract(lower({T}), '(\\d+)\\s+лет', 1), '') end as age from typed",
    ),
    (
        "records",
        "select *, case record_type " + " ".join(f"when '{k}' then {mean(k)}" for k in FIELDS) + f" else 0.0::double end as average_confidence, length({T}) as source_length, 'rule_based' as method, 'ru' as language, true as needs_review from valued",
    ),
]
REC = ctes(*EXTRACTED)

# Resolution

_KEYS = {k: f[0] for k, f in fixed.NAME_VARIANTS}
_FORMS: dict = {}
_KEY_LISTS = {k: "|".join(f) for k, f in fixed.NAME_VARIANTS}
_FORM_LISTS: dict = {}
for _key, _forms in fixed.NAME_VARIANTS:
    for _form in _forms:
        _FORMS.setdefault(_form, _forms[0])
        _FORM_LISTS.setdefault(_form, "|".join(_forms))


def canonical(n):
    return f"coalesce({look(_KEYS, f'lower({n})')}, {look(_FORMS, n)}, {n})"


def first(n):
    return f"coalesce(({words(n)})[1], '')"


def last(n):
    return f"array_to_string(({words(n)})[2:], ' ')"


def whole(n):
    return f"trim({canonical(first(n))} || ' ' || {canonical(last(n))})"


def easter(y):
    d = f"((19 * ({y} % 19) + 15) % 30)"
    k = f"({d} + (2 * ({y} % 4) + 4 * ({y} % 7) - {d} + 34) % 7 + 114)"
    return f"{y} || '-' || lpad(cast({k} // 31 as varchar), 2, '0') || '-' || lpad(cast({k} % 31 + 1 as varchar), 2, '0')"


def feast(t, given):
    own = f"nullif(regexp_extract({t}, '\\b(\\d{{4}})\\b', 1), '')"
    best = f"coalesce(cast(nullif({given}, 0) as varchar), {own})"
    outs = {"original": t, "resolved": t, "is_approximate": "false", "confidence": "1.0::double"}
    cases = {k: "case" for k in outs}
    for ref, kind in fixed.CALENDAR:
        test = f" when contains(lower({t}), {q(ref)}) then "
        if kind == "movable":
            v = {
                "original": f"case when {best} is null then {t} else 'Пасха ' || {best} end",
                "resolved": f"case when {best} is null then 'Пасха unknown' else {easter(f'cast({best} as int)')} end",
                "is_approximate": f"{best} is null",
                "confidence": f"case when {best} is null then 0.3::double else 0.85::double end",
            }
        elif kind == "circa":
            v = {"original": t, "resolved": f"coalesce({own} || '-01-01', 'circa')", "is_approximate": "true", "confidence": f"case when {own} is null then 0.2::double else 0.5::double end"}
        else:
            v = {"original": t, "resolved": f"coalesce({best}, '0000') || '-{kind}'", "is_approximate": "false", "confidence": "0.8::double"}
        for k in cases:
            cases[k] += test + v[k]
    return {k: f"{cases[k]} else {outs[k]} end" for k in outs}


def resolved_date(v):
    ref = " or ".join(f"contains(lower({v}), {q(r)})" for r, _ in fixed.CALENDAR)
    year = f"try_cast(nullif(regexp_extract({v}, '\\b(\\d{{4}})\\b', 1), '') as int)"
    return f"case when {v} <> 'Unknown' and ({ref} or not regexp_matches({v}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}')) then {feast(v, year)['resolved']} end"


def parsed(x):
    return f"coalesce(try_cast(case when regexp_matches({x}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') then {x} end as date), case when regexp_matches({x}, '^\\d{{4}}$') then make_date(cast({x} as int), 1, 1) end)"


AGES = [
    ("ages", fx.AGES),
    ("d", f"select *, case when death <> 'Unknown' then {parsed('death')} - {parsed('birth')} end as dd, {parsed('reference')} - {parsed('birth')} as dr from ages"),
    (
        "a",
        """select *, case when dd > 0 then dd when dr > 0 then dr end as days,
        case when dd > 0 then 'birth_death_difference' when dr > 0 then 'reference_date_' || reference when birth <> 'Unknown' and length(birth) = 4 then 'birth_year_only' else 'insufficient_data' end as source,
        case when dd > 0 then 0.9::double when dr > 0 then 0.7::double when birth <> 'Unknown' and length(birth) = 4 then 0.3::double else 0.0::double end as confidence from d""",
    ),
]

PEOPLE = [
    *EXTRACTED,
    (
        "people",
        " union all ".join(
            f"select rec_id, {k} as role_no, '{f}' as role, {f} as name, ({words(f)})[-1] as surname, record_type from records where {f} <> 'Unknown' and len({words(f)}) >= 2"
            for k, f in enumerate(fixed.NAME_FIELDS)
        ),
    ),
]


def kin(people):
    return f"""select 'parent_child' as type, a.name as person1, b.name as person2, case a.role when 'father_name' then 'father' else 'mother' end as parent_role, 0.8::double as confidence, a.rec_id as rec1, b.rec_id as rec2
    from {people} a join {people} b using (surname) where a.role in ('father_name', 'mother_name') and b.role = 'child_name'"""


# records are compared by value: those of one couple, date and length are equal
SPOUSES = """select 'spouse' as type, a.name as person1, b.name as person2, null::varchar as parent_role, 0.9::double as confidence, a.rec_id as rec1, b.rec_id as rec2
  from people a join people b using (surname) join records ra on ra.rec_id = a.rec_id join records rb on rb.rec_id = b.rec_id
  where a.role = 'groom_name' and b.role = 'bride_name' and a.rec_id <= b.rec_id and ra.record_type = rb.record_type and ra.groom_name = rb.groom_name
    and ra.bride_name = rb.bride_name and ra.marriage_date = rb.marriage_date and ra.source_length = rb.source_length"""

# Layout

SEG = """select page_id, row_number() over (partition by page_id order by s) - 1 as ord, s as "start", e as "end" from runs where e - s > {n}"""


def runs(threshold):
    return f"""select page_id, min(i) as s, max(i) + 1 as e from (select page_id, i, i - row_number() over (partition by page_id order by i) as g from profile where n > {threshold}) z group by page_id, g"""


ELEM = ("elements", fx.ELEMENTS)
CLASS = "case when mean is null or mean > 250 then 'empty' when variance > 300 and edges > 0.08 then 'handwritten' when variance > 50 then 'printed' else 'empty' end"
CLASSED = ("classed", f"select *, case when type = 'table' then null else {CLASS} end as region_type, {CLASS} as any_type from elements")
PAGES = [
    ("rows_", fx.ROWS),
    ("cols_", fx.COLUMNS),
    ("facts", "select * from (select page_id, count(*) as n_rows, sum(end_ - start_) as h from rows_ group by page_id) join (select page_id, count(*) as n_cols from cols_ group by page_id) using (page_id)"),
]
ASPECT = "(case when y2 - y1 > 0 then (x2 - x1) / (y2 - y1)::double else 0.0 end)"
ROUND = "(4.0::double * pi() * area / (perimeter * perimeter))"

READ = [
    ("ocr", fx.OCR),
    (
        "read_",
        """select page_id, position, case when t1 <> '' then t1 else t2 end as text, case when t1 <> '' then 0.8::double else c2 end as confidence,
        case when t1 <> '' then 'trocr' else 'easyocr' end as model_used,
        case when t1 <> '' then 'trocr' when c2 >= 0.3 then 'easyocr' when length(t3) > length(t2) then 'tesseract' else 'easyocr' end as voted from ocr""",
    ),
]
PAIRS = [
    (
        "pairs",
        f"""select stem, image_path, text from (select 's' || doc_id as stem, 'data/images/s' || doc_id || '.png' as image_path from labels)
        join (select 's' || doc_id as stem, {strip('text')} as text from documents) using (stem) where length(text) >= 2""",
    )
]
BOXES = ("boxes", fx.BOXES)
GRAY = "(b * 1868 + g * 9617 + r * 4899 + 8192) // 16384"
ANSWER = {
    f: f"case when {f} is null then null when rec_id % 2 = 0 then 'ответ {f}' else 'Unknown' end" for f in ALL_FIELDS
}


def values(kind):
    return ", ".join([n for n, _, _ in FIELDS[kind]] + (["age"] if kind == "death" else []))


def _prompt_head():
    shapes = "\n".join(f"{k}: " + ", ".join([*(n for n, _, _ in f), *(["age"] if k == "death" else [])]) for k, f in FIELDS.items())
    return (
        "Извлеки данные из записи метрической книги. Ответь одним объектом JSON с ключом record_type и полями этого типа, "
        'каждое в виде {"value": "...", "confidence": 0.0}; чего нет, то "Unknown". Даты пиши как YYYY-MM-DD.\n'
        f"{shapes}\nТекст:\n"
    )


SPLIT = "case when rn <= floor(total * 0.1) then 'test' when rn <= 2 * floor(total * 0.1) then 'val' else 'train' end"
RANKED = ("ranked", "select doc_id, row_number() over (order by md5(cast(doc_id as varchar)), doc_id) as rn, count(*) over () as total from documents")

ORACLE = {
    "extraction_summary": REC
    + "select record_type, count(*) as n, round(avg(average_confidence), 6) as mean_confidence, cast(sum(source_length) as bigint) as chars, count(*) filter (needs_review) as n_review from records group by record_type",
    "merge_hyphens": step(1),
    "expand_abbrev": step(2),
    "fix_ocr": step(3),
    "spell_correct": step(4),
    "normalize_dates": step(5),
    "cleanup_pipeline": ctes(*CLEAN)
    + "select rec_id, corrected_text, corrected_text as original_text, array_to_string(list_filter(["
    + ", ".join(f"case when t{k} <> {'t' if k == 1 else f't{k - 1}'} then {q(LABELS[k - 1])} end" for k in range(1, 7))
    + "], lambda s: s is not null), ',') as corrections from cleaned",
    "wrap_documents": f"with w as (select doc_id, {wrap('text')} as t from documents) select doc_id, md5(t) as wrapped_md5, 1 + length(t) - length(replace(t, chr(10), '')) as n_lines from w",
    "type_scores": ctes(*EXTRACTED[: len(CLEAN) + 1]) + "select rec_id, birth, death, marriage from scored",
    "type_argmax": ctes(*EXTRACTED[: len(CLEAN) + 2]) + "select rec_id, record_type from typed",
    "extract_date": ctes(TEXT) + f"select rec_id, {date('raw_text')} as found from metrical_text",
    "name_after": ctes(TEXT) + f"select rec_id, {name('raw_text', 'отец')} as father, {name('raw_text', 'от')} as loose, {name('raw_text', 'жених')} as groom from metrical_text",
    **{
        f"{k}_records": REC + f"select rec_id, {values(k)}, average_confidence, source_length, method, language, needs_review from records where record_type = '{k}'"
        for k in FIELDS
    },
    "empty_input": ctes(TEXT, ("e", f"select case when rec_id % 3 = 0 then {rep('raw_text', '[^ ]', '')} else {rep('raw_text', '[А-Яа-яЁё]', '')} end as t from metrical_text"))
    + f"select case when {strip('t')} = '' then 'empty_input' else 'rule_based' end as method, 'unknown' as record_type, case when {strip('t')} = '' then 0 else length(t) end as source_length, count(*) as n from e group by all",
    "llm_gate": REC + "select rec_id, average_confidence, average_confidence < 0.4 as asks from records",
    "llm_merge": REC
    + "select rec_id, "
    + ", ".join(f"case when rec_id % 6 = 0 and {f} = 'Unknown' then 'ответ {f}' else {f} end as {f}" for f in ALL_FIELDS)
    + ", case when rec_id % 3 = 0 then 'hybrid' else method end as method, rec_id % 3 = 0 as llm_used, average_confidence from records",
    "llm_prefer": REC
    + "select rec_id, "
    + ", ".join(
        f"case when rec_id % 3 = 0 and average_confidence < 0.7 then case when {ANSWER[f]} = 'Unknown' and {f} <> 'Unknown' then {f} else {ANSWER[f]} end else {f} end as {f}"
        for f in ALL_FIELDS
    )
    + ", case when rec_id % 3 = 0 and average_confidence < 0.7 then 'llm' else method end as method from records",
    "llm_prompt": ctes(TEXT) + f"select rec_id, md5({q(_prompt_head())} || raw_text) as prompt_md5 from metrical_text",
    "llm_salvage": ctes(("answers", fx.ANSWERS_RAW))
    + "select rec_id, nullif(regexp_extract(response, '\"record_type\"\\s*:\\s*\"([^\"]+)\"', 1), '') as record_type, "
    + ", ".join(f"nullif(regexp_extract(response, '\"{f}\"\\s*:\\s*\\{{\"value\"\\s*:\\s*\"([^\"]+)\"', 1), '') as {f}" for f in SALVAGED)
    + " from answers",
    "name_resolution": ctes(TEXT, ("names", f"select rec_id, {name('raw_text', 'отец')} as name from metrical_text"))
    + f"""select rec_id, name, case when name = 'Unknown' then name else {whole('name')} end as canonical,
      case when name = 'Unknown' then '' else {canonical(first('name'))} end as first_name,
      case when name = 'Unknown' then '' else {canonical(last('name'))} end as last_name,
      case when name = 'Unknown' then '' else coalesce({look(_KEY_LISTS, f"lower({first('name')})")}, {look(_FORM_LISTS, first('name'))}, {look(_KEY_LISTS, f"lower({last('name')})")}, '') end as variants,
      case when name = 'Unknown' then 0.0::double when coalesce({look(_KEY_LISTS, f"lower({first('name')})")}, {look(_FORM_LISTS, first('name'))}, {look(_KEY_LISTS, f"lower({last('name')})")}) is null then 0.6::double else 0.9::double end as confidence
      from names""",
    "feast_resolution": ctes(("feasts", fx.FEASTS)) + "select rec_id, " + ", ".join(f"{v} as {k}" for k, v in feast("txt", "given").items()) + " from feasts",
    "easter_by_year": f"select y, {easter('y')} as easter from (select distinct cast(year(o_orderdate) - 120 as int) as y from orders)",
    "age_compute": ctes(*AGES)
    + "select rec_id, cast(days // 365 as int) as age_years, cast(days as int) as age_days, source, confidence, case when source = 'birth_year_only' then 'Родился ' || birth end as note from a",
    "age_validate": ctes(AGES[0], AGES[1], ("c", "select *, cast(case when dd > 0 then dd // 365 end as int) as computed_age from d"))
    + """select rec_id, case when coalesce(written, 0) <> 0 and coalesce(computed_age, 0) <> 0 then abs(written - computed_age) <= 2 else true end as is_consistent, computed_age, written as extracted_age,
      case when coalesce(written, 0) <> 0 and coalesce(computed_age, 0) <> 0 then abs(written - computed_age) end as difference,
      case when coalesce(written, 0) <> 0 and coalesce(computed_age, 0) <> 0 then case when abs(written - computed_age) <= 2 then 0.85::double else 0.4::double end else 0.3::double end as confidence from c""",
    "resolve_records": REC
    + "select rec_id, "
    + ", ".join(f"case when {f} <> 'Unknown' then {whole(f)} end as {f}" for f in fixed.NAME_FIELDS)
    + ", "
    + ", ".join(f"{resolved_date(f)} as {f}" for f in ("birth_date", "death_date", "marriage_date"))
    + " from records",
    "people_exploded": ctes(*PEOPLE) + "select rec_id, role, name, surname, record_type from people",
    "family_groups": ctes(*PEOPLE)
    + "select surname, count(*) as size, min(rec_id) as first_seen, arg_min(name, rec_id * 10 + role_no) as first_name, arg_min(role, rec_id * 10 + role_no) as first_role from people group by surname having count(*) >= 2",
    "family_sizes": ctes(*PEOPLE) + "select surname, count(*) as size, min(rec_id) as first_seen from people group by surname having count(*) >= 2",
    "family_members": ctes(*PEOPLE) + "select surname, size, first_seen, rec_id, role_no, role, name from people join (select surname, count(*) as size, min(rec_id) as first_seen from people group by surname having count(*) >= 2) using (surname)",
    "kin_classes": ctes(("people", fx.KIN))
    + "select *, (fathers + mothers) * children as edges from (select surname, count(*) filter (role = 'father_name') as fathers, count(*) filter (role = 'mother_name') as mothers, count(*) filter (role = 'child_name') as children, count(*) filter (role = 'groom_name') as grooms, count(*) filter (role = 'bride_name') as brides from people group by surname)",
    "relationships": ctes(*PEOPLE) + kin("people") + " union all " + SPOUSES,
    "kinship": ctes(("people", fx.KIN)) + kin("people"),
    "profile_segments": ctes(("profile", fx.PROFILE), ("runs", runs(1.0))) + SEG.format(n=1),
    "line_positions": ctes(
        ("profile", fx.PROFILE),
        ("runs", runs(1.0)),
        ("ends", "select page_id, max(i) + 1 as length from profile group by page_id"),
        ("lines", "select page_id, (s + e) // 2 as pos from runs join ends using (page_id) where e - s > 2 and e < length"),
        ("between_", "select page_id, coalesce(lag(pos) over (partition by page_id order by pos), 0) as s, pos as e from lines"),
        ("parts", "select page_id, s, e from between_ where e - s > 15 union all select page_id, coalesce((select max(pos) from lines l where l.page_id = ends.page_id), 0), 1440 from ends"),
    )
    + 'select page_id, row_number() over (partition by page_id order by s) - 1 as ord, s as "start", e as "end" from parts where s < e',
    "table_page_test": ctes(*PAGES) + "select page_id, n_rows >= 2 and h / 1000.0 >= 0.2 as is_table from facts",
    "table_confidence": ctes(*PAGES)
    + "select page_id, case when n_rows >= 5 and n_cols >= 3 then 0.9::double when n_rows >= 3 and n_cols >= 2 then 0.7::double when n_rows >= 2 and n_cols >= 2 then 0.5::double else 0.3::double end as confidence from facts",
    "cell_grid": ctes(*PAGES)
    + 'select page_id, r.ord as "row", c.ord as col, c.start_ as x1, r.start_ as y1, c.end_ as x2, r.end_ as y2, r.ord = 0 or c.ord = 0 as is_header from rows_ r join cols_ c using (page_id) where r.end_ > r.start_ and c.end_ > c.start_',
    "record_blocks": ctes(
        PAGES[0],
        ("o", "select *, end_ - start_ as h, row_number() over (partition by page_id order by ord) as n, lag(end_ - start_) over (partition by page_id order by ord) as b from rows_"),
        ("p", "select *, sum(case when b > 0 and abs(h - b) > 15 then 1 else 0 end) over (partition by page_id order by ord rows unbounded preceding) as block from o where n > 1"),
    )
    + """select page_id, 'header_row' as type, 0 as x1, start_ as y1, 2400 as x2, end_ as y2, 0.9::double as confidence, 1 as row_count from o where n = 1
      union all select page_id, 'record_block', 0, arg_min(start_, ord), 2400, arg_max(end_, ord), 0.8::double, count(*) from p group by page_id, block""",
    "block_types": ctes(ELEM) + "select page_id, ord, case when edges > 0.05 then 'birth' else 'unknown' end as record_type from elements",
    "reading_order": ctes(ELEM) + "select page_id, ord, row_number() over (partition by page_id order by y1, x1, ord) - 1 as position from elements",
    "region_class": ctes(ELEM, CLASSED) + "select page_id, ord, any_type as region_type, case when mean > 250 then 0.0::double when any_type <> 'empty' then 0.8::double else 0.3::double end as confidence from classed",
    "layout_summary": ctes(ELEM, CLASSED)
    + "select page_id, count(*) as num_elements, "
    + ", ".join(
        f"count(*) filter ({c}) as {n}"
        for n, c in {
            "tables": "type = 'table'", "cells": "type = 'data_cell'", "record_blocks": "type = 'record_block'", "handwritten_cells": "type = 'data_cell' and region_type = 'handwritten'",
            "printed_cells": "type = 'data_cell' and region_type = 'printed'", "text_blocks": "type = 'text_block'", "stamps": "type = 'stamp'", "marginal_notes": "type = 'marginal_note'",
            "page_numbers": "type = 'page_number'", "signatures": "type = 'signature'",
        }.items()
    )
    + ", case when count(*) filter (type = 'table') > 0 then 'table' else 'text' end as page_type from classed group by page_id",
    "region_dispatch": ctes(ELEM, CLASSED)
    + """select page_id, ord, case when type = 'data_cell' then case when any_type = 'handwritten' then 'handwritten' else 'data_cell' end when type in ('text_block', 'header_row') then 'printed_text' when type in ('record_block', 'data_row') then 'table_cell' else 'printed_text' end as region,
      case when type = 'record_block' then 'table_cell' when type in ('data_cell', 'stamp', 'signature') then type else 'printed_text' end as by_type from classed""",
    "readable_elements": ctes(ELEM)
    + "select * from (select page_id, ord, type, least(x1, 1200) as x1, least(y1, 1500) as y1, least(x2, 1200) as x2, least(y2, 1500) as y2 from elements where type in ('data_cell', 'text_block', 'header_row', 'record_block')) where x2 > x1 and y2 > y1",
    "contour_filters": ctes(ELEM)
    + f"""select page_id, ord, area >= 500 and {ASPECT} > 0.5 and {ASPECT} < 10 and y2 - y1 > 15 as text_block, least(0.8::double, area / 100000.0::double * 10) as text_confidence,
      area >= 400 and area <= 20000 and ({ROUND} > 0.5 or ({ASPECT} > 0.7 and {ASPECT} < 1.3 and x2 - x1 > 20)) as stamp, round(least(0.9::double, {ROUND} / 2 + 0.4::double), 2) as stamp_confidence,
      edges > 0.01 and edges < 0.1 and x2 - x1 > 10 and x2 - x1 < 100 and y2 - y1 > 10 and y2 - y1 < 50 as page_number,
      variance * 3 > 1000 and edges * 2 > 0.15 and x2 - x1 > 50 and y2 - y1 > 15 and area > 300 as signature,
      false as note, edges >= 0.05 and y2 - y1 > 40 and x2 - x1 > 20 and (y2 - y1) * (x2 - x1) > 800 as note_intended from elements""",
    "yolo_rows": ctes(BOXES)
    + "select page_id, row_number() over (partition by page_id order by y1, ord) - 1 as ord, y1 as \"start\", y2 as \"end\" from boxes where label in ('table', 'record_block', 'header_row', 'data_row')",
    "yolo_columns": ctes(
        BOXES,
        ("xs", "select page_id, x1 as x from boxes where label = 'data_cell' union select page_id, x2 from boxes where label = 'data_cell'"),
        ("pairs", "select page_id, x as s, lead(x) over (partition by page_id order by x) as e from xs"),
        ("cols_", "select page_id, s, e from pairs where e - s > 20"),
        ("all_", "select * from cols_ union all select distinct page_id, 0, 800 from boxes where page_id not in (select page_id from cols_)"),
    )
    + 'select page_id, row_number() over (partition by page_id order by s) - 1 as ord, s as "start", e as "end" from all_',
    "ocr_cascade": ctes(*READ) + "select page_id, position, text, confidence, model_used, voted from read_",
    "ocr_blocks": ctes(READ[0]) + "select page_id, trim(string_agg(t2, ' ' order by position, t2)) as text, round(avg(c2), 4) as confidence, count(*) as blocks from ocr group by page_id",
    "page_text": ctes(
        *READ,
        ("full_", f"select page_id, coalesce(string_agg(text, chr(10) order by position, text) filter ({rep('text', chr(92) + 's', '')} <> ''), '') as full_text from read_ group by page_id"),
    )
    + "select page_id, full_text, substring(full_text, 1, 500) as preview from full_",
    "upload_filter": ctes(("uploads", fx.UPLOADS)) + "select * from uploads where (lower(name) like '%.jpg' or lower(name) like '%.jpeg' or lower(name) like '%.png') and (size is null or size <= 52428800)",
    "results_page": ctes(("results", fx.RESULTS))
    + "select request_id, file, coalesce(record_type, 'unknown') as record_type, coalesce(needs_review, true) as needs_review, coalesce(time, 0.0) as time, (select count(*) from results) as total from results order by request_id desc limit 50 offset 20",
    "result_get": ctes(("results", fx.RESULTS)) + "select * from results where request_id = 'c4ca4238'",
    "result_delete": ctes(("results", fx.RESULTS)) + "select * from results where request_id not in (select request_id from results where record_type = 'birth')",
    "batch_rollback": ctes(
        ("files", fx.BATCHES),
        ("bad", "select *, min(ord) filter (not ok) over (partition by batch_id) as first_bad, count(*) over (partition by batch_id) as n from files"),
    )
    + "select batch_id, count(*) as total, count(*) filter (ok) as success, count(*) filter (not ok) as failed, count(*) filter (not ok) > 0 as rollback from bad where (first_bad is null or ord <= first_bad) and n <= 20 group by batch_id",
    "pair_scan": ctes(*PAIRS) + "select * from pairs",
    "split_dataset": ctes(RANKED) + f"select doc_id, {SPLIT} as split from ranked",
    "split_counts": ctes(RANKED) + f"select {SPLIT} as split, count(*) as n from ranked group by 1",
    "sample_limit": "select doc_id from documents order by md5(cast(doc_id as varchar)), doc_id limit 100",
    "crop_filter": ctes(ELEM, CLASSED) + "select page_id, ord, type, x1, y1, x2, y2 from classed where ((type = 'data_cell' and any_type = 'handwritten') or type = 'text_block') and x2 - x1 > 10 and y2 - y1 > 10",
    "exact_match": ctes(READ[0]) + f"select round(avg(case when {strip('t2')} = {strip('t3')} then 1.0 else 0.0 end), 6) as accuracy, count(*) as n from ocr",
    "path_rewrite": ctes(*PAIRS) + "select stem, replace(image_path, 'data/images/', '/mnt/') as image_path from pairs",
    "gray_world": ctes(("px", fx.PIXELS), ("ms", "select page_id, avg(b) as mb, avg(g) as mg, avg(r) as mr from px group by page_id"), ("m", "select *, (mr + mg + mb) / 3.0 as m from ms"))
    + "select page_id, x, y, "
    + ", ".join(f"cast(floor(least(greatest({c} * least(greatest(m / greatest(m{c}, 1.0), 0.7::double), 1.3::double), 0.0), 255.0)) as int) as {c}" for c in "bgr")
    + " from px join m using (page_id)",
    "border_removal": ctes(("px", fx.PIXELS))
    + "select page_id, x, y, " + ", ".join(f"case when x < 3 or x >= 22 or y < 3 or y >= 17 then 255 else {c} end as {c}" for c in "bgr") + " from px",
    "quality_metrics": ctes(
        ("px", fx.PIXELS),
        ("gr", f"select page_id, x, y, {GRAY} as v from px"),
        (
            "lap",
            """select page_id, x, y, v,
          coalesce(lag(v) over (partition by page_id, y order by x), lead(v) over (partition by page_id, y order by x))
        + coalesce(lead(v) over (partition by page_id, y order by x), lag(v) over (partition by page_id, y order by x))
        + coalesce(lag(v) over (partition by page_id, x order by y), lead(v) over (partition by page_id, x order by y))
        + coalesce(lead(v) over (partition by page_id, x order by y), lag(v) over (partition by page_id, x order by y)) - 4 * v as l from gr""",
        ),
    )
    + "select page_id, round(stddev_pop(v), 2) as contrast, round(var_pop(l), 2) as sharpness, round(-sum((v / 255.0::double + 1e-10) * ln(v / 255.0::double + 1e-10)), 2) as entropy from lap group by page_id",
    "resize_dims": """with d as (select p_partkey, p_partkey % 4000 + 100 as w, p_size * 90 + 50 as h from part),
      s as (select *, case when greatest(w, h) < 1500 then 1500.0::double / greatest(w, h) when greatest(w, h) > 3000 then 3000.0::double / greatest(w, h) else 1.0::double end as k from d)
      select p_partkey, cast(floor(w * k) as int) as new_w, cast(floor(h * k) as int) as new_h from s""",
    "deskew_median": ctes(ELEM)
    + "select page_id, round(median(edges * 100 - 5), 6) as angle, abs(round(median(edges * 100 - 5), 6)) >= 0.3 as rotate from elements where area >= 1500 group by page_id",
    "page_layout": """with k as (select s_suppkey as k from supplier),
      r as (select k, unnest([0, 62 + k % 7, 132 + k % 11, 202 + k % 13]) as y1, unnest([62 + k % 7, 132 + k % 11, 202 + k % 13, 320]) as y2, unnest([0, 1, 2, 3]) as nr from k),
      c as (select k, unnest([0, 102 + k % 17]) as x1, unnest([102 + k % 17, 280]) as x2, unnest([0, 1]) as nc from k)
      select 'page' || k as page_id, 'data_cell' as type, cast(x1 as int) as x1, cast(y1 as int) as y1, cast(x2 as int) as x2, cast(y2 as int) as y2, cast(nr as varchar) as row, cast(nc as varchar) as col from r join c using (k)
      union all select 'page' || k, 'table', 0, 0, 280, 320, null, null from k
      union all select 'page' || k, 'stamp', 200, 250, 240, 290, null, null from k""",
    "text_blocks": """with k as (select s_suppkey as k from supplier),
      b as (select k, 40 + k % 9 as x, 30 as y, 120 + k % 13 as w, 40 as h from k union all select k, 60, 120, 200, 60 + k % 7 from k union all select k, 30, 230, 250, 30 from k)
      select 'page' || k as page_id, 'text_block' as type, cast(x - 21 as int) as x1, cast(y - 6 as int) as y1, cast(x + w + 21 as int) as x2, cast(y + h + 6 as int) as y2,
        cast((w + 41) * (h + 11) as bigint) || ' ' || cast(round((w + 42) / (h + 12)::double, 2) as varchar) as note from b""",
    "page_marks": """with k as (select s_suppkey as k from supplier),
      b as (select k, 'page_number' as type, 300 + k % 50 as x, 8 + k % 5 as y, 30 + k % 20 as w, 20 as h, 'top_margin' as note from k
        union all select k, 'marginal_note', 3, 198 + k % 30, 26, 64 + k % 40, 'left_margin' from k
        union all select k, 'stamp', 500 + k % 40, 300 + k % 30, 40 + k % 15, 40 + k % 15, 'red' from k
        union all select k, 'stamp', 600, 450, 30 + k % 10, 30 + k % 10, 'blue' from k)
      select 'page' || k as page_id, type, cast(x as int) as x1, cast(y as int) as y1, cast(x + w as int) as x2, cast(y + h as int) as y2, note from b""",
    "fallback_grid": """with k as (select s_suppkey as k from supplier), i as (select unnest([0, 1, 2, 3, 4, 5, 6]) as i)
      select 'page' || k as page_id, 'row' as type, 0 as x1, cast(20 + k % 8 + 40 * i as int) as y1, 0 as x2, cast(32 + k % 8 + 40 * i as int) as y2, cast(null as varchar) as note from k, i
      union all select 'page' || k, 'column', 0, 0, 400, 0, null from k""",
}
