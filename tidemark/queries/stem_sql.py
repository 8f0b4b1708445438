"""The stemmers as SQL: a chain of views that ends with ``stems(word, stem)``.

The views start from a view ``forms(word)`` of different lowercase words.
"""

from __future__ import annotations

from ..functions import stemming as s


def _quoted(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _map(pairs: dict[str, str]) -> str:
    return "map {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


def _region(text: str, vowels: str) -> str:
    found = f"length(regexp_extract({text}, '^.*?[{vowels}][^{vowels}]'))"
    return f"case when {found} > 0 then {found} else length({text}) end"


def _chain(prefix: str, steps: list[str]) -> str:
    """Views that each change some columns of the one before."""
    views = [f"{prefix}0 as (select word, word as w from forms)"]
    for i, change in enumerate(steps):
        views.append(f"{prefix}{i + 1} as (select {change} from {prefix}{i})")
    return ", ".join(views)


def _set(**columns: str) -> str:
    return "* replace (" + ", ".join(f"{v} as {k}" for k, v in columns.items()) + ")"


def _add(**columns: str) -> str:
    return "*, " + ", ".join(f"{v} as {k}" for k, v in columns.items())


def _find(endings) -> str:
    return f"regexp_extract(w, '({'|'.join(endings)})$', 1)"


CUT = "left(w, length(w) - length(e))"
BEFORE = "substr(w, length(w) - length(e), 1)"
START = "length(w) - length(e)"


def _swap(endings: dict[str, str], test: str, find: str) -> list[str]:
    swapped = f"case when e <> '' and {test} then {CUT} || {_map(endings)}[e] else w end"
    return [find.format(_find(endings)), _set(w=swapped)]


def english() -> str:
    v, short = f"[{s.ENGLISH_VOWELS}]", s.ENGLISH_SHORT
    marked = f"regexp_replace(regexp_replace(regexp_replace(w, '^''', ''), '^y', 'Y'), '({v})y', '\\1Y', 'g')"
    special = f"length(regexp_extract(w, '^({s.ENGLISH_REGION_PREFIXES})'))"
    plural = f"""case when regexp_matches(w, 'sses$') then left(w, length(w) - 2)
        when regexp_matches(w, '(ied|ies)$') then left(w, length(w) - case when length(w) > 4 then 2 else 1 end)
        when regexp_matches(w, '(us|ss)$') then w
        when regexp_matches(w, '{v}.+s$') then left(w, length(w) - 1) else w end"""
    past = f"""case when e in ('eedly', 'eed') then case when {START} >= p1 then {CUT} || 'ee' else w end
        when cut then {CUT} else w end"""
    mend = f"""case when not cut then w when regexp_matches(w, '(at|bl|iz)$') then w || 'e'
        when regexp_matches(w, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') then left(w, length(w) - 1)
        when p1 >= length(w) and regexp_matches(w, '{short}') then w || 'e' else w end"""
    last = f"""case when (right(w, 1) = 'e' and (length(w) - 1 >= p2 or (length(w) - 1 >= p1
          and not regexp_matches(left(w, length(w) - 1), '{short}')))) or (right(w, 2) = 'll' and length(w) - 1 >= p2)
        then left(w, length(w) - 1) else w end"""
    valid = f"({START} >= p1 and case e when 'ogi' then {BEFORE} = 'l' when 'li' then contains('cdeghkmnrt', {BEFORE}) else true end)"
    again = _set(e="{}")
    steps = [
        _set(w=marked),
        _add(p1=f"case when {special} > 0 then {special} else {_region('w', s.ENGLISH_VOWELS)} end"),
        _add(p2=f"p1 + {_region('substr(w, p1 + 1)', s.ENGLISH_VOWELS)}"),
        _set(w="regexp_replace(w, '(''s''|''s|'')$', '')"),
        _set(w=plural),
        _add(kept=f"case when w in {_quoted(s.ENGLISH_DONE_EARLY)} then w end", e=_find(["eedly", "eed", "edly", "ed", "ingly", "ing"])),
        _add(cut=f"e in ('edly', 'ed', 'ingly', 'ing') and regexp_matches({CUT}, '{v}')"),
        _set(w=past),
        _set(w=mend),
        _set(w="case when regexp_matches(w, '^.+[^aeiouy][yY]$') then left(w, length(w) - 1) || 'i' else w end"),
        *_swap(s.ENGLISH_STEP_2, valid, again),
        *_swap(s.ENGLISH_STEP_3, f"{START} >= case when e = 'ative' then p2 else p1 end", again),
        *_swap(dict.fromkeys(s.ENGLISH_STEP_4, ""), f"{START} >= p2 and (e <> 'ion' or {BEFORE} in ('s', 't'))", again),
        _set(w=last),
    ]
    irregular = " ".join(f"when word = '{k}' then '{x}'" for k, x in s.ENGLISH_IRREGULAR.items())
    return (
        _chain("en", steps)
        + f""", stems as (select word, case when length(word) <= 2 or word in {_quoted(s.ENGLISH_UNCHANGED)} then word
            {irregular} when kept is not null then kept else lower(w) end as stem from en{len(steps)})"""
    )


def porter() -> str:
    above = lambda text, n: f"regexp_matches({text}, '{(s.PORTER_MORE_THAN_0, s.PORTER_MORE_THAN_1)[n]}')"
    less = lambda n: f"left(w, length(w) - {n})"
    shorter = "left(w, length(w) - case when length(w) = 4 then 1 else 2 end)"
    plural = f"""case when right(w, 1) <> 's' then w when right(w, 3) = 'ies' then {shorter}
        when right(w, 4) = 'sses' then {less(2)} when right(w, 2) = 'ss' then w else {less(1)} end"""
    past = f"""case when e = 'ied' then {shorter} when e = 'eed' then case when {above(CUT, 0)} then {less(1)} else w end
        when cut then {CUT} else w end"""
    mend = f"""case when not cut then w when regexp_matches(w, '(at|bl|iz)$') then w || 'e'
        when regexp_matches(w, '{s.PORTER_DOUBLE}') then case when regexp_matches(w, '[lsz]$') then w else {less(1)} end
        when {above('w', 0)} and not {above('w', 1)} and regexp_matches(w, '{s.PORTER_SHORT}') then w || 'e' else w end"""
    last_e = f"""case when right(w, 1) = 'e' and ({above(less(1), 1)} or ({above(less(1), 0)}
        and not regexp_matches({less(1)}, '{s.PORTER_SHORT}'))) then {less(1)} else w end"""
    again = _set(e="{}")
    steps = [
        _set(w="regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g')"),
        _set(w=plural),
        _add(e=_find(["ied", "eed", "ed", "ing"])),
        _add(cut=f"e in ('ed', 'ing') and regexp_matches({CUT}, '[aeiouy]')"),
        _set(w=past),
        _set(w=mend),
        _set(w="case when length(w) > 2 and right(w, 1) = 'y' then left(w, length(w) - 1) || 'i' else w end"),
        _set(w=f"case when right(w, 4) = 'alli' and {above(less(4), 0)} then {less(2)} else w end"),
        *_swap(s.PORTER_STEP_2, above("left(w, length(w) - case when e = 'logi' then 3 else length(e) end)", 0), again),
        *_swap(s.PORTER_STEP_3, above(CUT, 0), again),
        *_swap(dict.fromkeys(s.PORTER_STEP_4, ""), f"{above(CUT, 1)} and (e <> 'ion' or {BEFORE} in ('s', 't'))", again),
        _set(w=last_e),
        _set(w=f"case when right(w, 2) = 'll' and {above(less(1), 1)} then {less(1)} else w end"),
    ]
    irregular = " ".join(f"when word = '{k}' then '{x}'" for k, x in s.PORTER_IRREGULAR.items())
    return (
        _chain("po", steps)
        + f", stems as (select word, case {irregular} when length(word) <= 2 then word else lower(w) end as stem from po{len(steps)})"
    )


def _behind(pattern: str) -> str:
    """A pattern that looks behind for a or ya, with the letter as a group instead, to be put back."""
    return pattern.replace("(?<=[ая])", "([ая])")


def russian() -> str:
    region = lambda x: _region(x, s.RUSSIAN_VOWELS)
    cut = lambda x, pattern: f"regexp_replace({x}, '{_behind(pattern)}', '\\1')" if "(?<=" in pattern else f"regexp_replace({x}, '{pattern}', '')"
    has = lambda x, pattern: f"regexp_matches({x}, '{_behind(pattern)}')"
    inflection = f"""case when {has('rv', s.RUSSIAN_GERUND)} then {cut('rv', s.RUSSIAN_GERUND)}
        when {has('base', s.RUSSIAN_ADJECTIVE)} then {cut(cut('base', s.RUSSIAN_ADJECTIVE), s.RUSSIAN_PARTICIPLE)}
        when {has('base', s.RUSSIAN_VERB)} then {cut('base', s.RUSSIAN_VERB)} else {cut('base', s.RUSSIAN_NOUN)} end"""
    tidy = f"""head || case when right(rv, 2) = 'нн' then left(rv, length(rv) - 1)
        when {has('rv', s.RUSSIAN_SUPERLATIVE)} then regexp_replace({cut('rv', s.RUSSIAN_SUPERLATIVE)}, 'нн$', 'н')
        else regexp_replace(rv, 'ь$', '') end"""
    steps = [
        _set(w="replace(w, 'ё', 'е')"),
        _add(p1=region("w"), head=f"coalesce(nullif(regexp_extract(w, '^[^{s.RUSSIAN_VOWELS}]*[{s.RUSSIAN_VOWELS}]'), ''), w)"),
        _add(p2=f"p1 + {region('substr(w, p1 + 1)')}", rv="substr(w, length(head) + 1)"),
        _add(base=f"regexp_replace(rv, '{s.RUSSIAN_REFLEXIVE}', '')"),
        _set(rv=inflection),
        _set(rv="regexp_replace(rv, 'и$', '')"),
        _add(e=f"length(regexp_extract(rv, '{s.RUSSIAN_DERIVATION}'))"),
        _set(rv="case when e > 0 and length(head) + length(rv) - e >= p2 then left(rv, length(rv) - e) else rv end"),
    ]
    return _chain("ru", steps) + f", stems as (select word, {tidy} as stem from ru{len(steps)})"
