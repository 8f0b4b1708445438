"""Text preparation and diagnosis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, text
from ..functions.storage import spread
from ..operators import language, lemma_rules, sentences, text_diagnosis, text_steps, vocabulary
from . import stem_sql
from .registry import query, rounded, table

# The patterns in the notation of the SQL engine.
SPECIAL = r"[^\p{L}\p{N}_\s\p{Z}]"
SPECIAL_BUT_PUNCTUATION = r"[^\p{L}\p{N}_\s\p{Z}.,!?]"
WORD = r"[\p{L}\p{N}_]+(?:''[\p{L}\p{N}_]+)?"
TOKEN = WORD + "|" + SPECIAL
OUTER = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all({x}, '{TOKEN}')"


def words_sql(x: str) -> str:
    return f"regexp_extract_all({x}, '{WORD}')"


def sentences_sql(x: str) -> str:
    gaps = rf"regexp_replace({x}, '([.!?])[\s\p{{Z}}]+', '\1' || chr(1), 'g')"
    trimmed = f"list_transform(string_split({gaps}, chr(1)), lambda s: regexp_replace(s, '{OUTER}', '', 'g'))"
    return f"list_filter({trimmed}, lambda s: s <> '')"


def stop_list(lang: str) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in text.stop_words(lang)) + "]"


def _documents(spark, folder):
    return spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


def _pages(spark, folder):
    return spread(table(spark, folder, "pages").select("page_id", "html"), "page_id")


@query("t1_remove_html", "select page_id, regexp_replace(html, '<[^>]+>', '', 'g') as html from pages")
def t1(spark, folder):
    return text_steps.remove_html(_pages(spark, folder), "html")


@query("t2_remove_special_chars", f"select page_id, regexp_replace(html, '{SPECIAL}', '', 'g') as html from pages")
def t2(spark, folder):
    return text_steps.remove_special_chars(_pages(spark, folder), "html")


@query(
    "t2_keep_punctuation",
    f"select doc_id, regexp_replace(text, '{SPECIAL_BUT_PUNCTUATION}', '', 'g') as text from documents",
)
def t2_keep(spark, folder):
    return text_steps.remove_special_chars(_documents(spark, folder), "text", keep_punctuation=True)


@query("t3_replace_numbers", r"select doc_id, regexp_replace(text, '\p{Nd}+', '[NUM]', 'g') as text from documents")
def t3(spark, folder):
    return text_steps.number_handling(_documents(spark, folder), "text", "replace")


@query("t3_remove_numbers", r"select doc_id, regexp_replace(text, '\p{Nd}+', '', 'g') as text from documents")
def t3_remove(spark, folder):
    return text_steps.number_handling(_documents(spark, folder), "text", "remove")


@query(
    "t4_word_tokens",
    f"""with t as (select doc_id, {tokens_sql('text')} as w from documents)
  select doc_id, cast(len(w) as integer) as n, array_to_string(w, ' ') as tokens from t""",
)
def t4(spark, folder):
    df = text_steps.tokenize(_documents(spark, folder), "text", "word")
    return df.select("doc_id", F.size("text").alias("n"), text.as_text(F.col("text")).alias("tokens"))


# Abbreviations are planted where conversations join words, so that the corpus has some to learn.
PLANTED = [(" and ", " resp. "), (" und ", " bzw. "), (" et ", " p.ex. "), (" y ", " approx. ")]


def _planted_sql(x: str) -> str:
    for a, b in PLANTED:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _sentence_sql() -> str:
    quoted = lambda p: p.replace("'", "''")
    space, closers = text.SPACE_CLASS, quoted(sentences.CLOSERS)
    stop = rf"'\.{closers}*$'"
    kind = lambda w: rf"regexp_replace(lower(regexp_replace({w}, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}.]+$', '', 'g')), '\.$', '')"
    log = lambda x: f"ln(greatest({x}, 1e-12))"
    one = lambda hits, misses, share: f"(({hits}) * {log(share)} + ({misses}) * {log(f'1 - ({share})')})"
    first = lambda s: rf"regexp_extract({s}, '^[{space}]*([^{space}]+)', 1)"
    last = lambda s: rf"regexp_extract({s}, '([^{space}]+)[{space}]*$', 1)"
    within = f"(regexp_matches(l, {stop}) and (list_contains((select list(type) from abbreviations), {kind('l')}) or regexp_matches({kind('l')}, '^\\p{{L}}$')))"
    return rf"""
  with c as materialized (select conv_id, turn, {_planted_sql('text')} as text from conversations),
  w as (select unnest(regexp_split_to_array(text, '[{space}]+')) as w from c),
  counts as materialized (select {kind('w')} as type, cast(sum(case when regexp_matches(w, {stop}) then 1 else 0 end) as double) as stops,
             cast(count(*) as double) as total from w where w <> '' group by all),
  sums as materialized (select sum(stops) as s, sum(total) as n from counts),
  scored as (select type, 2 * ({one('stops', 'total - stops', str(sentences.SHARE_OF_STOPS))} - {one('stops', 'total - stops', 's / n')})
               * exp(-signs) * (length(type) - signs + 1) * pow(signs, -(total - stops)) as score
    from (select *, length(replace(type, '.', '')) as signs from counts), sums where stops > 0 and regexp_matches(type, '\p{{L}}')),
  abbreviations as materialized (select type from scored where score >= {sentences.LEAST_ABBREVIATION}),
  parts as (select conv_id, turn, regexp_extract_all(text, '[\s\S]+?(?:[.!?]{closers}*[{space}]+|$)') as p from c),
  placed as materialized (select conv_id, turn, generate_subscripts(p, 1) as i, unnest(p) as s from parts),
  ends as materialized (select *, {last('s')} as l, lead(s) over (partition by conv_id, turn order by i) as after from placed),
  pairs as materialized (select *, {first('after')} as f, {within} as inside from ends),
  after as materialized (select {kind('f')} as type, cast(count(*) as double) as a from pairs
                          where after is not null and not inside and not regexp_matches(f, '^\p{{Ll}}') group by all),
  breaks as materialized (select sum(a) as b from after),
  starters as materialized (select type from (select counts.type, total, least(a, total) as h, n, b, a from counts join after using (type), sums, breaks
      where regexp_matches(counts.type, '^\p{{L}}+$')) where a / b > total / n and
      2 * ({one('h', 'b - h', 'h / b')} + {one('total - h', 'n - b - total + h', '(total - h) / greatest(n - b, 1)')}
           - {one('h', 'b - h', 'total / n')} - {one('total - h', 'n - b - total + h', 'total / n')}) >= {sentences.LEAST_STARTER}),
  flagged as (select *, case when after is null then true
       when inside then regexp_matches(f, '^[^\p{{L}}\p{{N}}]*\p{{Lu}}') and list_contains((select list(type) from starters), {kind('f')})
       else not regexp_matches(f, '^\p{{Ll}}') end as last from pairs),
  grouped as (select *, coalesce(sum(case when last then 1 else 0 end) over (partition by conv_id, turn order by i
       rows between unbounded preceding and 1 preceding), 0) as g from flagged),
  made as (select conv_id, turn, g, regexp_replace(string_agg(s, '' order by i), '{text.OUTER_SPACE}', '', 'g') as sentence from grouped group by all),
  joined as (select conv_id, turn, cast(count(*) as integer) as n, string_agg(sentence, ' | ' order by g) as sentences
             from made where sentence <> '' group by all)
  select c.conv_id, c.turn, coalesce(n, 0) as n, coalesce(sentences, '') as sentences from c left join joined using (conv_id, turn)"""


@query("t5_sentence_tokens", _sentence_sql())
def t5(spark, folder):
    planted = F.col("text")
    for a, b in PLANTED:
        planted = F.replace(planted, F.lit(a), F.lit(b))
    df = table(spark, folder, "conversations").select("conv_id", "turn", planted.alias("text"))
    df = text_steps.tokenize(df, "text", "sentence")
    return df.select("conv_id", "turn", F.size("text").alias("n"), F.array_join("text", " | ").alias("sentences"))


@query(
    "t6_split_sentences",
    f"""with t as (select doc_id, {sentences_sql('text')} as s from documents)
  select doc_id, cast(generate_subscripts(s, 1) - 1 as integer) as place, unnest(s) as sentence from t""",
)
def t6(spark, folder):
    df = _documents(spark, folder)
    return df.select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("place", "sentence"))


@query(
    "t7_remove_stopwords",
    f"""select doc_id, array_to_string(list_filter({tokens_sql('lower(text)')},
          lambda t: not list_contains({stop_list('english')}, t)), ' ') as text from documents""",
)
def t7(spark, folder):
    return text_steps.remove_stopwords(_documents(spark, folder), "text", "english")


def stemmed_sql(spread: str, keys: str, out: str, stems: str | None = None) -> str:
    """Stems joined again per text; ``spread`` gives (keys, pos, word)."""
    return f"""rows_ as ({spread}), forms as (select distinct word from rows_), {stems or stem_sql.english()}
  select {keys}, string_agg(stem, ' ' order by pos) as {out}
  from rows_ join stems on stems.word = rows_.word group by all"""


def spread_sql(view: str, keys: str, x: str) -> str:
    return f"""select {keys}, generate_subscripts(ws, 1) as pos, unnest(ws) as word
      from (select {keys}, {tokens_sql('lower(' + x + ')')} as ws from {view})"""


@query(
    "t8_stem_english",
    f"""with s as (with {stemmed_sql(spread_sql('documents', 'doc_id', 'text'), 'doc_id', 'text')})
  select d.doc_id, coalesce(s.text, '') as text from documents d left join s on s.doc_id = d.doc_id""",
)
def t8(spark, folder):
    return vocabulary.stem_text(_documents(spark, folder), "text", ["doc_id"], "english")


@query(
    "t8_stem_porter",
    f"""with s as (with {stemmed_sql(spread_sql('documents', 'doc_id', 'text'), 'doc_id', 'text', stem_sql.porter())})
  select d.doc_id, coalesce(s.text, '') as text from documents d left join s on s.doc_id = d.doc_id""",
)
def t8_porter(spark, folder):
    return vocabulary.stem_text(_documents(spark, folder), "text", ["doc_id"], "porter")


# No table has Russian text: the words of the conversations are spelled with Cyrillic letters, so that
# their endings meet the Russian rules.
LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абсвефйшияклмнопщьстуюыхыя"


@query(
    "t8_stem_russian",
    f"""with c as (select conv_id, turn, translate(lower(text), '{LATIN}', '{CYRILLIC}') as text from conversations),
  s as (with {stemmed_sql(spread_sql('c', 'conv_id, turn', 'text'), 'conv_id, turn', 'text', stem_sql.russian())})
  select c.conv_id, c.turn, coalesce(s.text, '') as text from c left join s on s.conv_id = c.conv_id and s.turn = c.turn""",
)
def t8_russian(spark, folder):
    spelled = F.translate(F.lower("text"), LATIN, CYRILLIC).alias("text")
    df = table(spark, folder, "conversations").select("conv_id", "turn", spelled)
    return vocabulary.stem_text(df, "text", ["conv_id", "turn"], "russian")


FORMS = f"""
  with w as (select distinct unnest({words_sql('lower(text)')}) as form from documents),
  lemmas as (select a.form, b.form as lemma from w a join w b on a.form = b.form || 's' and length(b.form) > 2)
"""


def plural_lemmas(spark, folder):
    """Forms that are another word of the collection with an s."""
    forms = _documents(spark, folder).select(F.explode(text.words(F.lower("text"))).alias("form")).distinct()
    singular = forms.select(F.concat("form", F.lit("s")).alias("plural"), F.col("form").alias("lemma"))
    found = forms.join(singular, F.col("form") == F.col("plural")).where(F.length("lemma") > 2)
    return found.select(F.lit("english").alias("lang"), "form", "lemma")


@query(
    "t9_lemmatize",
    FORMS
    + f""", t as (select doc_id, {tokens_sql('lower(text)')} as ws from documents),
  r as (select doc_id, generate_subscripts(ws, 1) as pos, unnest(ws) as word from t),
  j as (select doc_id, string_agg(coalesce(lemma, word), ' ' order by pos) as text
        from r left join lemmas on lemmas.form = r.word group by doc_id)
  select t.doc_id, coalesce(j.text, '') as text from t left join j on j.doc_id = t.doc_id""",
)
def t9(spark, folder):
    return vocabulary.lemmatize_text(
        _documents(spark, folder), "text", ["doc_id"], plural_lemmas(spark, folder), "english"
    )


# Half of the forms, by a hash, are known; the others get their lemmas by rules.
KNOWN = """known as materialized (select form, min(lemma) as lemma from lemmas
    where cast('0x' || substr(md5(form), 1, 4) as integer) % 2 = 0 group by form),
  own as materialized (select * from known union all
    select distinct lemma, lemma from known where lemma not in (select form from known))"""
RULES = f"""e as (select form, length(form) - same as off, substr(lemma, same + 1) as put from (
    select *, len(list_filter(range(1, least(length(form), length(lemma)) + 1), lambda i: left(form, i) = left(lemma, i))) as same from own)),
  s as (select *, unnest(range(greatest(off, 1), least(length(form) - {lemma_rules.LEAST_STEM}, {lemma_rules.LONGEST}) + 1)) as size from e),
  k as (select right(form, size) as ending, off, put, count(*) as forms from s group by all),
  b as (select *, sum(forms) over (partition by ending) as total,
               row_number() over (partition by ending order by forms desc, off, put) as nth from k),
  good as materialized (select ending, off, put from b where nth = 1 and forms >= {lemma_rules.LEAST_FORMS} and forms / total >= {lemma_rules.LEAST_SHARE}),
  met as (select g.ending, arg_max({{'o': h.off, 'p': h.put}}, length(h.ending)) as n
          from good g join good h on length(h.ending) < length(g.ending) and right(g.ending, length(h.ending)) = h.ending group by g.ending),
  rules as materialized (select good.* from good left join met using (ending)
    where case when n is null then off > 0 or put <> '' else n.o <> off or n.p <> put end)"""


@query(
    "t9_lemmatize_unknown",
    FORMS
    + f""", {KNOWN}, {RULES}, t as (select doc_id, {tokens_sql('lower(text)')} as ws from documents),
  r as (select doc_id, generate_subscripts(ws, 1) as pos, unnest(ws) as word from t),
  dw as (select distinct word from r),
  guess as (select word, arg_max(left(word, length(word) - off) || put, length(ending)) as lemma from dw join rules
            on right(word, length(ending)) = ending and length(word) >= length(ending) + {lemma_rules.LEAST_STEM} group by word),
  made as (select word, coalesce(own.lemma, guess.lemma, word) as lemma from dw left join own on own.form = dw.word left join guess using (word)),
  j as (select doc_id, string_agg(lemma, ' ' order by pos) as text from r join made using (word) group by doc_id)
  select t.doc_id, coalesce(j.text, '') as text from t left join j on j.doc_id = t.doc_id""",
)
def t9_unknown(spark, folder):
    known = plural_lemmas(spark, folder).where(F.conv(F.substring(F.md5(F.col("form")), 1, 4), 16, 10).cast("int") % 2 == 0)
    return vocabulary.lemmatize_text(_documents(spark, folder), "text", ["doc_id"], known, "english", guess=True)


@query(
    "t10_text_steps",
    rf"""with a as (select page_id, regexp_replace(html, '<[^>]+>', '', 'g') as x from pages),
  b as (select page_id, regexp_replace(x, '{SPECIAL_BUT_PUNCTUATION}', '', 'g') as x from a),
  c as (select page_id, regexp_replace(x, '\p{{Nd}}+', '[NUM]', 'g') as x from b),
  d as (select page_id, list_transform({tokens_sql('x')}, lambda t: lower(t)) as x from c)
  select page_id, array_to_string(list_filter(x, lambda t: not list_contains({stop_list('english')}, t)), ' ') as html
  from d""",
)
def t10(spark, folder):
    return text_steps.prepare_text(
        _pages(spark, folder),
        "html",
        [
            "remove_html",
            ("remove_special_chars", {"keep_punctuation": True}),
            ("handle_numbers", {"strategy": "replace"}),
            ("tokenize", {"token_type": "word"}),
            ("remove_stopwords", {"lang": "english"}),
        ],
    )


@query(
    "t10_text_steps_with_stems",
    rf"""with a as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '{SPECIAL}', '', 'g'),
        '\p{{Nd}}+', '', 'g') as x from pages),
  b as (select page_id, array_to_string(list_filter({tokens_sql('lower(x)')},
          lambda t: not list_contains({stop_list('english')}, t)), ' ') as x from a),
  s as (with {stemmed_sql(spread_sql('b', 'page_id', 'x'), 'page_id', 'html')})
  select b.page_id, coalesce(s.html, '') as html from b left join s on s.page_id = b.page_id""",
)
def t10_stems(spark, folder):
    return text_steps.prepare_text(
        _pages(spark, folder),
        "html",
        [
            "remove_html",
            "remove_special_chars",
            ("handle_numbers", {"strategy": "remove"}),
            ("remove_stopwords", {"lang": "english"}),
            ("normalize", {"method": "stem", "lang": "english"}),
        ],
        key=["page_id"],
    )


@query("x1_length", "select doc_id, cast(length(text) as integer) as length from documents")
def x1(spark, folder):
    return _documents(spark, folder).select("doc_id", F.length("text").alias("length"))


NAMES = sorted(text.LANGUAGES.values())


def hits_sql(words: str) -> str:
    return ", ".join(
        f"len(list_filter({words}, lambda t: list_contains({stop_list(n)}, lower(t)))) as {n}" for n in NAMES
    )


def language_sql(x: str) -> str:
    best = f"greatest({', '.join(NAMES)})"
    cases = " ".join(f"when {n} = {best} then '{n}'" for n in NAMES)
    return rf"""case when len(regexp_replace({x}, '[^Ѐ-ӿ]', '', 'g')) * 2 >
        len(regexp_replace({x}, '[^\p{{L}}\p{{N}}_]', '', 'g')) then 'russian'
      when {best} = 0 then '{text.DEFAULT_LANGUAGE}' {cases} end"""


HITS = f"""with w as (select doc_id, text, {tokens_sql('text')} as words from documents),
  h as (select *, {hits_sql('words')} from w), """


@query("x2_language", HITS + f"l as (select doc_id, {language_sql('text')} as language from h) select * from l")
def x2(spark, folder):
    df = _documents(spark, folder).withColumn("hits", language.hits_by_language(text.tokens(F.col("text"))))
    return df.select("doc_id", language.pick_language(F.col("text"), F.col("hits")).alias("language"))


def grams_sql(view: str, keys: str) -> str:
    return f"""select {keys}, substr(x, i, 3) as gram, count(*) as n
      from (select {keys}, lower(text) as x, unnest(generate_series(1, length(text) - 2)) as i from {view})
      group by all"""


@query(
    "x3_language_model",
    f"""with c as ({grams_sql('documents', 'lang')}),
  v as (select count(distinct gram) as v from c), t as (select lang, sum(n) as n from c group by lang),
  g as (select distinct gram from c),
  m as (select g.gram, t.lang, ln((coalesce(c.n, 0) + 1) / cast(t.n + v.v as double)) as p
        from g cross join t cross join v left join c on c.gram = g.gram and c.lang = t.lang),
  q as ({grams_sql('conversations', 'conv_id, turn')}),
  s as (select conv_id, turn, lang, sum(n * p) as score from q join m on m.gram = q.gram group by all),
  b as (select conv_id, turn, arg_min(lang, (-score, lang)) as lang from s group by all)
  select k.conv_id, k.turn, b.lang from conversations k left join b on b.conv_id = k.conv_id and b.turn = k.turn""",
)
def x3(spark, folder):
    labelled = spread(table(spark, folder, "documents").select("doc_id", "text", "lang"), "doc_id")
    model = language.train_language_model(labelled, "text", "lang")
    return language.classify_language(
        table(spark, folder, "conversations"), "text", ["conv_id", "turn"], model
    )


@query(
    "x4_stopword_ratio",
    f"""with w as (select doc_id, {tokens_sql('text')} as words from documents)
  select doc_id, round(case when len(words) = 0 then 0.0 else
      len(list_filter(words, lambda t: list_contains({stop_list('english')}, lower(t)))) / len(words) end, 6) as ratio from w""",
)
def x4(spark, folder):
    df = _documents(spark, folder).withColumn("words", text.tokens(F.col("text")))
    ratio = text_diagnosis.stop_word_ratio(text.stop_word_hits(F.col("words"), "english"), F.col("words"))
    return rounded(df.select("doc_id", ratio.alias("ratio")), 6, "ratio")


DIFFERENCE = (
    FORMS.replace("lemmas as", "lemmas as materialized")
    + f""", rows_ as ({spread_sql('documents', 'doc_id', 'text')}), forms as (select distinct word from rows_),
  {stem_sql.porter()},
  x as (select r.doc_id, cast(sum(case when stem <> coalesce(lemma, r.word) then 1 else 0 end) as bigint) as stem_diff,
               count(*) as total_words
        from rows_ r join stems on stems.word = r.word left join lemmas on lemmas.form = r.word group by all),
  diff as (select d.doc_id, coalesce(stem_diff, 0) as stem_diff, coalesce(total_words, 0) as total_words
           from documents d left join x on x.doc_id = d.doc_id)
"""
)
STEM_ACTION = """case when total_words > 0 and stem_diff / total_words > 0.3 then 'lemmatize'
    when total_words > 0 and stem_diff / total_words > 0.1 then 'lemmatize_or_stem' else 'stem' end"""


@query("x5_stem_lemma_difference", DIFFERENCE + "select * from diff")
def x5(spark, folder):
    return vocabulary.stem_lemma_difference(
        _documents(spark, folder), "text", ["doc_id"], plural_lemmas(spark, folder), "english"
    )


FLAGS = rf"""regexp_matches(text, '<[^>]+>') as html, regexp_matches(text, '{SPECIAL_BUT_PUNCTUATION}') as special,
             regexp_matches(text, '\p{{Nd}}') as digits"""


@query(
    "x6_cleaning_flags",
    f"""with f as (select page_id, {FLAGS} from (select page_id, html as text from pages))
  select page_id, array_to_string([case when html then 'remove_html' end,
      case when special then 'remove_special_chars' end, case when digits then 'handle_numbers' end], ', ') as actions
  from f""",
)
def x6(spark, folder):
    df = _pages(spark, folder)
    found = F.array_compact(F.array(*text_diagnosis.cleaning_advice(F.col("html"))))
    return df.select("page_id", F.array_join(F.transform(found, lambda a: a["action"]), ", ").alias("actions"))


TASKS = [*labels.TASK_RULES, "unknown"]
AUTO = """case when n_s = 0 or n_w < 5 then 'word_tokenize' when n_w > n_s * 15 then 'sentence_tokenize'
          when contains(array_to_string(s, ' '), '?') then 'sentence_tokenize' else 'word_tokenize' end"""
SIZES = f"""z as (select doc_id, len({tokens_sql('text')}) as n_w, {sentences_sql('text')} as s, len({sentences_sql('text')}) as n_s
                  from documents)"""


@query(
    "x7_tokenize_by_task",
    f"with {SIZES} "
    + " union all ".join(
        f"select '{t}' as task, "
        + (f"'{labels.TASK_RULES[t][0]}'" if t in labels.TASK_RULES else AUTO)
        + " as action, count(*) as n from z group by all"
        for t in TASKS
    ),
)
def x7(spark, folder):
    df = _documents(spark, folder).select(
        text.tokens(F.col("text")).alias("w"), text.sentences(F.col("text")).alias("s")
    )
    advised = F.array(
        *[
            F.struct(F.lit(t).alias("task"), text_diagnosis.tokenize_advice(F.col("w"), F.col("s"), t)["action"].alias("action"))
            for t in TASKS
        ]
    )
    return df.select(F.inline(advised)).groupBy("task", "action").agg(F.count("*").alias("n"))


@query("x8_tokenize_automatic", f"with {SIZES} select doc_id, {AUTO} as action from z")
def x8(spark, folder):
    df = _documents(spark, folder).select(
        "doc_id", text.tokens(F.col("text")).alias("w"), text.sentences(F.col("text")).alias("s")
    )
    return df.select("doc_id", text_diagnosis.tokenize_advice(F.col("w"), F.col("s"))["action"].alias("action"))


@query(
    "x9_stopword_advice",
    f"""with w as (select doc_id, {tokens_sql('text')} as words from documents),
  r as (select doc_id, case when len(words) = 0 then 0.0 else
      len(list_filter(words, lambda t: list_contains({stop_list('english')}, lower(t)))) / len(words) end as r from w)
  select doc_id, case when r > 0.4 then 'remove_stopwords' when r > 0.2 then 'consider_remove_stopwords' end as action from r""",
)
def x9(spark, folder):
    df = _documents(spark, folder).withColumn("words", text.tokens(F.col("text")))
    ratio = text_diagnosis.stop_word_ratio(text.stop_word_hits(F.col("words"), "english"), F.col("words"))
    return df.select("doc_id", text_diagnosis.stop_word_advice(ratio)["action"].alias("action"))


@query("x10_stem_lemma_advice", DIFFERENCE + f"select doc_id, {STEM_ACTION} as action from diff")
def x10(spark, folder):
    diff = vocabulary.stem_lemma_difference(
        _documents(spark, folder), "text", ["doc_id"], plural_lemmas(spark, folder), "english"
    )
    return diff.select(
        "doc_id",
        text_diagnosis.stem_lemma_advice(F.col("stem_diff"), F.col("total_words"))["action"].alias("action"),
    )


OWN = "case l.language " + " ".join(f"when '{n}' then h.{n}" for n in NAMES) + " end"


def _said(action: str, description: str) -> str:
    return f"'{action}: ' || {description} || ' / {labels.ACTION_LABELS[action]}'"


def _percent(told: str) -> str:
    return f"'{told} (' || cast(cast(round_even(ratio * 100, 0) as integer) as varchar) || '%)'"


ANALYSIS = (
    HITS
    + f"""l as (select doc_id, {language_sql('text')} as language from h),
  f as (select h.doc_id, h.text, h.words, l.language, {FLAGS},
               case when len(h.words) = 0 then 0.0 else {OWN} / len(h.words) end as ratio,
               {sentences_sql('h.text')} as s from h join l on l.doc_id = h.doc_id),
  r as (select *, list_filter([
      case when html then {_said('remove_html', "'" + labels.CLEANING['remove_html'] + "'")} end,
      case when special then {_said('remove_special_chars', "'" + labels.CLEANING['remove_special_chars'] + "'")} end,
      case when digits then {_said('handle_numbers', "'" + labels.CLEANING['handle_numbers'] + "'")} end,
      case when len(s) = 0 or len(words) < 5 then {_said('word_tokenize', "'" + labels.SHORT_TEXT + "'")}
           when len(words) > len(s) * 15 then {_said('sentence_tokenize', "'" + labels.LONG_SENTENCES + "'")}
           when contains(array_to_string(s, ' '), '?') then {_said('sentence_tokenize', "'" + labels.QUESTIONS + "'")}
           else {_said('word_tokenize', "'" + labels.STANDARD + "'")} end,
      case when ratio > 0.4 then {_said('remove_stopwords', _percent(labels.MANY_STOPWORDS))}
           when ratio > 0.2 then {_said('consider_remove_stopwords', _percent(labels.SOME_STOPWORDS))} end],
      lambda x: x is not null) as recs from f)
"""
)


def _told(column: str):
    return F.transform(
        column, lambda a: F.concat(a["action"], F.lit(": "), a["description"], F.lit(" / "), a["action_label"])
    )


@query("x11_recommendations", ANALYSIS + "select doc_id, array_to_string(recs, '; ') as recommendations from r")
def x11(spark, folder):
    df = text_diagnosis.analyze_texts(_documents(spark, folder), "text", ["doc_id"])
    return df.select("doc_id", F.array_join(_told("recommendations"), "; ").alias("recommendations"))


@query(
    "x12_analyze_texts",
    ANALYSIS
    + """select doc_id, cast(length(text) as integer) as length, language as detected_lang,
           round(ratio, 6) as stopword_ratio, cast(len(words) as integer) as n_words,
           cast(len(s) as integer) as n_sentences, array_to_string(recs, '; ') as recommendations from r""",
)
def x12(spark, folder):
    df = text_diagnosis.analyze_texts(_documents(spark, folder), "text", ["doc_id"])
    df = df.withColumn("recommendations", F.array_join(_told("recommendations"), "; ")).drop("stem_vs_lemma")
    return rounded(df, 6, "stopword_ratio")


STEM_SAID = f"""case {STEM_ACTION}
    when 'lemmatize' then {_said('lemmatize', "'" + labels.LEMMA_MUCH_BETTER + "'")}
    when 'lemmatize_or_stem' then {_said('lemmatize_or_stem', "'" + labels.LEMMA_BETTER + "'")}
    else {_said('stem', "'" + labels.STEM_ENOUGH + "'")} end"""


@query(
    "x12_analyze_texts_with_stems",
    f"""with r as ({ANALYSIS} select * from r), diff as ({DIFFERENCE} select * from diff)
  select r.doc_id, cast(length(text) as integer) as length, language as detected_lang,
         round(ratio, 6) as stopword_ratio, cast(len(words) as integer) as n_words,
         cast(len(s) as integer) as n_sentences, stem_diff, total_words,
         array_to_string(list_append(recs, {STEM_SAID}), '; ') as recommendations
  from r join diff on diff.doc_id = r.doc_id""",
)
def x12_stems(spark, folder):
    df = text_diagnosis.analyze_texts(
        _documents(spark, folder), "text", ["doc_id"], check_stem_lemma=True, lemmas=plural_lemmas(spark, folder)
    )
    return rounded(df, 6, "stopword_ratio").select(
        "doc_id", "length", "detected_lang", "stopword_ratio", "n_words", "n_sentences",
        F.col("stem_vs_lemma.stem_diff").alias("stem_diff"),
        F.col("stem_vs_lemma.total_words").alias("total_words"),
        F.array_join(_told("recommendations"), "; ").alias("recommendations"),
    )


@query(
    "x13_analyze_collection",
    ANALYSIS
    + """, u as (select distinct unnest(recs) as rec from r),
  m as (select language from r group by language order by count(*) desc, language limit 1)
  select (select round(avg(length(text)), 4) from r) as avg_length, (select language from m) as main_lang,
         (select string_agg(rec, '; ' order by rec) from u) as recommendations""",
)
def x13(spark, folder):
    df = text_diagnosis.analyze_collection(_documents(spark, folder), "text", ["doc_id"])
    df = df.withColumn("recommendations", F.array_join(F.array_sort(_told("recommendations")), "; "))
    return rounded(df, 4, "avg_length")


@query(
    "x14_word_statistics",
    f"""with w as (select doc_id, unnest({words_sql('lower(text)')}) as word from documents),
  c as (select doc_id, word, count(*) as n from w group by all),
  k as (select *, row_number() over (partition by doc_id order by n desc, word) as r from c)
  select d.doc_id, count(word) as unique_words, round(sum(length(word) * n) / sum(n), 6) as avg_word_length,
         coalesce(string_agg(case when r <= 5 then word end, ', ' order by r), '') as frequent_words
  from documents d left join k on d.doc_id = k.doc_id group by d.doc_id""",
)
def x14(spark, folder):
    df = vocabulary.word_statistics(_documents(spark, folder), "text", ["doc_id"])
    return rounded(df, 6, "avg_word_length")
