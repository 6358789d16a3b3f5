"""SQL over the given tables for every query: what the operators must agree with.

Written independently of the operators, with other means: a grid by join, de-duplication by
row_number, tokens by window functions.
"""

from __future__ import annotations

from . import bindings as b
from ..functions.valence import BOOSTERS_DOWN, BOOSTERS_UP, IDIOMS, NEGATIONS

EVENTS = """
events_scored as (
  select event_id, upper(event_type) as ticker,
         '$' || upper(event_type) || ' and $X' || user_id || ' or $VIEW' as title,
         'event://' || event_id as url,
         case when event_type in ('click', 'view') then 'yfinance' else 'reddit' end as source,
         ts as published_at, 'user ' || user_id as publisher, (value - 35.0) / 500.0 as score,
         cast(json_extract(props, '$.k') as double) / 100.0 as confidence
  from events),
scored as (
  select *, case when score >= 0.05 then 'positive' when score <= -0.05 then 'negative' else 'neutral' end as label
  from events_scored),
daily as (
  select ticker, cast(published_at as date) as date, avg(score) as sentiment, count(*) as n,
         avg(confidence) as confidence
  from scored group by 1, 2)"""

PRICES = """
px as (
  select case o_orderpriority when '1-URGENT' then 'CLICK' when '2-HIGH' then 'ERROR' when '3-MEDIUM' then 'VIEW'
              when '4-NOT SPECIFIED' then 'SIGNUP' else 'XPAY' end as ticker,
         date '2024-01-01' + cast(o_orderkey % 30 as integer) as date, avg(o_totalprice) as close
  from orders group by 1, 2),
prices as (
  select * from px where isodow(date) < 6 and not (ticker = 'VIEW' and date = date '2024-01-10'))"""

GRID = """
days as (select distinct date from prices),
names as (select distinct ticker from prices),
grid as (
  select d.date, t.ticker, p.close
  from days d cross join names t left join prices p on p.date = d.date and p.ticker = t.ticker)"""

RETURNS = GRID + """,
filled as (
  select date, ticker,
         last_value(close ignore nulls) over (partition by ticker order by date rows unbounded preceding) as close
  from grid),
r0 as (
  select date, ticker, close / nullif(lag(close) over (partition by ticker order by date), 0) - 1 as ret from filled),
rets as (select * from r0 where date in (select date from r0 group by date having count(ret) > 0)),
fwd as (select date, ticker, lead(ret) over (partition by ticker order by date) as fwd_ret from rets)"""

SIGNAL = """
aligned as (
  select s.date, s.ticker, s.sentiment, f.fwd_ret from daily s join fwd f on s.date = f.date and s.ticker = f.ticker
  where s.sentiment is not null and f.fwd_ret is not null),
sig as (
  select *, case when count(*) over (partition by ticker) >= 3
                 then case when sentiment > median(sentiment) over (partition by ticker) then 1 else -1 end
                 else case when sentiment >= 0 then 1 else -1 end end as signal
  from aligned),
pnl as (select date, avg(signal * fwd_ret) as pnl from sig group by date),
eq as (select date, pnl, product(1 + pnl) over (order by date rows unbounded preceding) as equity from pnl)"""

BACKTEST = f"with {EVENTS}, {PRICES}, {RETURNS}, {SIGNAL}"

METRICS = """
select round(1e-9 + (select max_by(equity, date) - 1 from eq), 6) as cumulative_return,
       round(1e-9 + (select case when count(*) > 1 then avg(pnl) / nullif(stddev_pop(pnl), 0) * sqrt(252) end from eq), 6)
         as sharpe,
       round(1e-9 + (select case when count(*) > 1
                          then covar_pop(sentiment, fwd_ret) / nullif(stddev_pop(sentiment) * stddev_pop(fwd_ret), 0) end
              from sig), 6) as correlation,
       (select count(*) from eq) as n_days"""

HEADLINES = """
doc_headlines as (
  select doc_id, 'yfinance' as source, upper(lang) as ticker, text as title,
         'doc://' || md5(text) as url, 1704067200 + doc_id * 60 as seconds, source as publisher, 0 as turn, doc_id as seq
  from documents),
page_headlines as (
  select null as doc_id, 'reddit' as source, upper(regexp_extract(url, '[.](com|org|net)/([a-z]+)', 2)) as ticker,
         regexp_extract(html, '<title>([^<]*)</title>', 1) as title, url, 1704067200 + page_id * 3600 as seconds,
         'r/wallstreetbets' as publisher, 1 as turn, page_id as seq
  from pages),
headlines as (select * from doc_headlines union all select * from page_headlines),
stored as (select h.* from doc_headlines h where exists (select 1 from labels l where l.doc_id = h.doc_id))"""


def _new_headlines(*keys: str) -> str:
    same = " and ".join(f"s.{key} = h.{key}" for key in keys)
    return f"""
ranked as (select *, row_number() over (partition by {', '.join(keys)} order by turn, seq) as place from headlines),
fresh as (
  select * from ranked h where place = 1 and not exists (select 1 from stored s where {same}))"""


LABEL_SCORES = """
label_scores as (
  select cast(doc_id as varchar) as headline_id, cast(quality - toxic as double) as score,
         case when quality - toxic > 0 then 'positive' when quality - toxic < 0 then 'negative' else 'neutral' end as label,
         cast(0.9 as double) as confidence, 'labels' as model
  from labels)"""

# Raw news shapes: what a reader of the landed lines must get out of them.
NEWS = """
news as (
  select event_id, upper(event_type) as ticker, 'Said "' || event_type || '" é ' || user_id as title,
         'event://' || event_id as url,
         case event_type
           when 'click' then epoch_us(date_trunc('second', ts))
           when 'error' then epoch_us(date_trunc('second', ts))
           when 'view' then epoch_us(date_trunc('second', ts)) - 19800000000
           when 'signup' then epoch_us(date_trunc('day', ts))
           else epoch_us(timestamp '2024-03-01') end as published_at,
         case event_type when 'click' then 'P' || user_id when 'view' then 'Desk' when 'signup' then 'Desk' end
           as publisher,
         event_type <> 'purchase' or value <= 50 as usable
  from events)"""

FORUM = """
posts as (
  select doc_id, '$EN ' || text || ' $' || upper(lang) as title, 'doc://' || doc_id as url,
         doc_id * 3600 * 1000000 as published_at, [upper(lang), 'EN'] as named
  from documents
  union all
  select doc_id, 're: $' || upper(lang) || ' $' || upper(lang) || 'X $FR', 'https://reddit.com/r/d/' || doc_id,
         epoch_us(timestamp '2024-03-01'), [upper(lang), 'FR']
  from documents),
mentions as (
  select distinct doc_id, title, url, published_at,
         unnest(list_concat(named, regexp_extract_all(title, '\\$([A-Z]{1,5})\\b', 1))) as ticker
  from posts)"""


def _strings(words) -> str:
    return ", ".join("'" + word.replace("'", "''") + "'" for word in words)


BLANK = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
MARK = r"""([.!?,;:\-''"]|!!|!!!|\?\?|\?\?\?|\?!\?|!\?!|\?!\?!|!\?!\?)"""
WORD = r"([^[:punct:]]{2,})"


def _lexicon(source: str, rules: bool = True) -> str:
    """The valence rules in window form: CTEs ending in lexicon_scores, over (id, text) rows of a source."""
    lexicon = ", ".join(f"('{token}', cast({valence} as double))" for token, valence in b.WORDS)
    up = _strings([*BOOSTERS_UP, *(["thly", "que"] if rules else [])])
    down = _strings([*BOOSTERS_DOWN, *(["ther", "den"] if rules else [])])
    negations = _strings([*NEGATIONS, *(["with", "this", "les"] if rules else [])])

    def idiom(phrase: str) -> str:
        return "case " + phrase + "".join(f" when '{words}' then {value}" for words, value in IDIOMS.items()) + " end"

    def negated(word: str) -> str:
        return f"(lower({word}) in ({negations}) or contains(lower({word}), 'n''t'))"

    def boosted(value: str, word: str, weight: str) -> str:
        size = f"case when lower({word}) in ({up}) then 0.293e0 when lower({word}) in ({down}) then -0.293e0 end"
        loud = f"case when {word} = upper({word}) and {word} <> lower({word}) and mixed then 0.733e0 else 0e0 end"
        return (
            f"{value} + coalesce(case when {value} > 0 then ({size}) + ({loud}) when {value} < 0 then -({size}) - ({loud})"
            f" else ({size}) - ({loud}) end, 0e0) * {weight}"
        )

    before = ", ".join(idiom(phrase) for phrase in (
        "w1 || ' ' || item", "w2 || ' ' || w1 || ' ' || item", "w2 || ' ' || w1",
        "w3 || ' ' || w2 || ' ' || w1", "w3 || ' ' || w2"))
    after2, after3 = idiom("item || ' ' || f1"), idiom("item || ' ' || f1 || ' ' || f2")
    return rf"""
lex(token, valence) as (values {lexicon}),
pieces as (select id, regexp_extract_all(text, '[^{BLANK}]{{2,}}') as list from {source}),
split as (select id, unnest(list) as piece, generate_subscripts(list, 1) as pos from pieces),
tok as (
  select id, pos,
         case when regexp_full_match(piece, '{MARK}{WORD}') then regexp_extract(piece, '^{MARK}{WORD}$', 2)
              when regexp_full_match(piece, '{WORD}{MARK}') then regexp_extract(piece, '^{WORD}{MARK}$', 1)
              else piece end as item
  from split),
whole as (
  select id, count(*) filter (item = upper(item) and item <> lower(item)) as caps, count(*) as tokens,
         min(pos) filter (lower(item) = 'but') as but_at
  from tok group by id),
seen as (
  select *, min(pos) over (partition by id, item) as first_pos,
         lag(item, 1) over w as w1, lag(item, 2) over w as w2, lag(item, 3) over w as w3,
         lead(item, 1) over w as f1, lead(item, 2) over w as f2
  from tok window w as (partition by id order by pos)),
hits as (
  select s.*, l.valence, o.caps > 0 and o.caps < o.tokens as mixed,
         lower(w1) in (select token from lex) as k1, lower(w2) in (select token from lex) as k2,
         lower(w3) in (select token from lex) as k3
  from seen s join lex l on l.token = lower(s.item) join whole o on o.id = s.id
  where pos = first_pos and lower(item) not in ({up}, {down})
    and not (lower(item) = 'kind' and coalesce(lower(f1), '') = 'of')),
step0 as (
  select *, case when item = upper(item) and item <> lower(item) and mixed
                 then valence + case when valence > 0 then 0.733e0 else -0.733e0 end else valence end as v0
  from hits),
step1 as (
  select *, case when w1 is null or k1 then v0
                 else ({boosted('v0', 'w1', '1e0')}) * case when {negated('w1')} then -0.74e0 else 1e0 end end as v1
  from step0),
step2 as (
  select *, case when w2 is null or k2 then v1
                 else ({boosted('v1', 'w2', '0.95e0')})
                      * case when w2 = 'never' and w1 in ('so', 'this') then 1.5e0
                             when {negated('w2')} then -0.74e0 else 1e0 end end as v2
  from step1),
step3 as (
  select *, case when w3 is null or k3 then v2
                 else coalesce({after3}, {after2}, {before},
                        ({boosted('v2', 'w3', '0.9e0')})
                        * case when (w3 = 'never' and w2 in ('so', 'this')) or w1 in ('so', 'this') then 1.25e0
                               when {negated('w3')} then -0.74e0 else 1e0 end)
                      - case when w3 || ' ' || w2 in ('just enough', 'kind of', 'sort of')
                               or w2 || ' ' || w1 in ('just enough', 'kind of', 'sort of') then 0.293e0 else 0e0 end
                 end as v3
  from step2),
valued as (
  select id, item,
         v3 * case when lower(w1) = 'least' and not k1 and coalesce(lower(w2), '') not in ('at', 'very')
                   then -0.74e0 else 1e0 end as v
  from step3),
weighted as (
  select t.id, coalesce(v.v, 0e0) * case when t.pos < o.but_at then 0.5e0 when t.pos > o.but_at then 1.5e0 else 1e0 end as v
  from tok t join whole o on o.id = t.id left join valued v on v.id = t.id and v.item = t.item),
sums as (
  select id, sum(v) as total, coalesce(sum(v + 1) filter (v > 0), 0) as up, coalesce(sum(1 - v) filter (v < 0), 0) as down,
         count(*) filter (v = 0) as flat
  from weighted group by id),
marks as (
  select id, length(text) - length(replace(text, '!', '')) as bangs, length(text) - length(replace(text, '?', '')) as asks
  from {source}),
emphasis as (
  select id, least(bangs, 4) * 0.292e0 + case when asks <= 1 then 0e0 when asks <= 3 then asks * 0.18e0 else 0.96e0 end as e
  from marks),
stressed as (
  select m.id, s.flat, s.total + sign(s.total) * e as total, s.up + case when s.up > s.down then e else 0 end as up,
         s.down + case when s.up < s.down then e else 0 end as down
  from emphasis m left join sums s on s.id = m.id),
rounded as (
  select id, coalesce(round_even(total / sqrt(total * total + 15), 4), 0e0) as score,
         greatest(coalesce(round_even(up / (up + down + flat), 3), 0e0), coalesce(round_even(flat / (up + down + flat), 3), 0e0),
                  coalesce(round_even(down / (up + down + flat), 3), 0e0)) as confidence
  from stressed),
lexicon_scores as (
  select id as headline_id,
         case when score >= 0.05 then 'positive' when score <= -0.05 then 'negative' else 'neutral' end as label,
         score, confidence, 'vader' as model
  from rounded)"""


TEXTS = "texts as (select cast(doc_id as varchar) as id, text from documents)"
LEXICON = f"with {TEXTS}, {_lexicon('texts')} select * from lexicon_scores"


def _end_to_end() -> str:
    """The landed rows again: stored headlines, their scores, the daily mean, the backtest."""
    words = ", ".join(f"('{word}', cast({value} as double))" for word, value in b.EVENT_WORDS)
    return f"""with {NEWS}, {FORUM}, {PRICES},
words(word, valence) as (values {words}),
landed as (
  select ticker, title, url, published_at from news where usable and ticker in ('CLICK', 'ERROR', 'VIEW', 'SIGNUP')),
tokens as (
  select url, unnest(string_split(title, ' ')) as token from landed),
sums as (
  select t.url, sum(coalesce(w.valence, 0)) as total
  from tokens t left join words w on w.word = t.token where length(t.token) > 1 group by t.url),
daily as (
  select ticker, cast(make_timestamp(published_at) as date) as date,
         avg(round_even(total / sqrt(total * total + 15), 4)) as sentiment
  from landed join sums using (url) group by 1, 2),
forum_daily as (
  select ticker, cast(make_timestamp(published_at) as date) as date from mentions where ticker = 'EN' group by 1, 2),
prices2 as (
  select * from prices
  where ticker in (select ticker from daily)
    and date >= (select greatest(min(date) - 3, date '2024-03-01' - 365) from daily)
    and date < (select max(date) + 3 from daily)),
{(RETURNS + ',' + SIGNAL).replace('prices', 'prices2')}
{METRICS}, cast(0 as bigint) as inserted_again,
  (select count(*) from daily) + (select count(*) from forum_daily) as daily_rows, (select count(*) from forum_daily) as forum_days"""


def _scored_stream() -> str:
    """Stored rows of both feeds (of a forum post, the first ticker by name) with their scores."""
    words = ", ".join(f"('{word}', cast({value} as double))" for word, value in b.EVENT_WORDS)
    label = "case when score >= 0.05 then 'positive' when score <= -0.05 then 'negative' else 'neutral' end"
    return f"""with {NEWS}, {FORUM},
words(word, valence) as (values {words}),
news_tokens as (select url, ticker, unnest(string_split(title, ' ')) as token from news where usable),
news_sums as (
  select url, ticker, sum(coalesce(w.valence, 0)) as total
  from news_tokens t left join words w on w.word = t.token where length(t.token) > 1 group by 1, 2),
news_scores as (select url, ticker, coalesce(round_even(total / sqrt(total * total + 15), 4), 0) as score from news_sums),
stored_posts as (
  select url, min(ticker) as ticker, any_value(substring(title, 1, 500)) as title from mentions
  where ticker in ({_strings(b.LANGUAGES)}) group by url),
post_texts as (select url as id, title as text from stored_posts),
{_lexicon('post_texts')}
select 'yfinance' as source, url, ticker, {label} as label, round(1e-9 + score, 6) as score from news_scores
union all
select 'reddit', url, ticker, label, round(1e-9 + score, 6) from lexicon_scores join stored_posts on url = headline_id"""


def oracle_sql() -> dict[str, str]:
    return {name: sql.strip() for name, sql in _ORACLE.items()}


_ROUNDED_DAILY = "select ticker, date, round(1e-9 + sentiment, 6) as sentiment, n, round(1e-9 + confidence, 6) as confidence from daily"
_DASHBOARD = f"""with {EVENTS.replace('daily as', 'all_days as')}, {PRICES},
       chosen as (select distinct ticker from all_days order by ticker limit 3),
       daily as (select * from all_days where ticker in (select ticker from chosen)),
       prices2 as (
         select * from prices where ticker in (select ticker from chosen)
           and date >= (select min(date) - 3 from daily) and date < (select max(date) + 3 from daily)),
       {(RETURNS + ',' + SIGNAL).replace('prices', 'prices2')}"""
_TICKERS = ["CLICK", "ERROR", "PURCHASE", "SIGNUP", "VIEW"]
_FRESH_COLUMNS = "select source, url, ticker, title, publisher from fresh"

_ORACLE: dict[str, str] = {
    "daily_sentiment": f"with {EVENTS} {_ROUNDED_DAILY}",
    "sentiment_pivot": f"with {EVENTS} select date, "
    + ", ".join(f"round(1e-9 + max(case when ticker = '{t}' then sentiment end), 6) as \"{t}\"" for t in _TICKERS)
    + " from daily group by date",
    "unpivot_sentiment": f"with {EVENTS} select date, ticker, round(1e-9 + sentiment, 6) as sentiment from daily "
    "where sentiment is not null",
    "wide_map": f"with {EVENTS} select date, ticker, round(1e-9 + sentiment, 6) as sentiment from daily where sentiment is not null",
    "ticker_summary": f"with {EVENTS} select ticker, count(*) as n, round(1e-9 + avg(score), 6) as mean_sentiment "
    "from scored group by ticker",
    "run_counters": f"""with {EVENTS} select count(*) filter (source = 'yfinance') as news_rows,
       count(*) filter (source = 'reddit') as forum_rows, count(score) as scored_rows,
       count(distinct cast(published_at as date)) filter (score is not null) as sentiment_days from scored""",
    "distinct_tickers": f"with {EVENTS} select distinct ticker from scored",
    "default_selection": f"with {EVENTS} select distinct ticker from scored order by ticker limit 3",
    "latest_feed": f"""with {EVENTS} select epoch_us(published_at) as published_at, ticker, source, label,
       round(1e-9 + score, 6) as score, title, publisher, url from scored order by scored.published_at desc, url limit 50""",
    "top_scored": f"""with {EVENTS} select ticker, label, round(1e-9 + score, 6) as score, title
       from scored order by scored.score desc, url limit 20""",
    "ticker_filter": f"with {EVENTS} select event_id, ticker, round(1e-9 + score, 6) as score from scored where ticker = 'CLICK'",
    "multi_select": f"""with {EVENTS} select event_id, ticker, round(1e-9 + score, 6) as score from scored
       where ticker in ('CLICK', 'VIEW')""",
    "min_history": f"""with {EVENTS} select ticker, date, round(1e-9 + sentiment, 6) as sentiment, n from daily
       where (select count(distinct date) from daily) >= 5""",
    "min_history_unmet": f"""with {EVENTS} select ticker, date, round(1e-9 + sentiment, 6) as sentiment, n from daily
       where (select count(distinct date) from daily) >= 10000""",
    "backtest_range": f"""with {EVENTS} select cast(greatest(min(date) - 3, date '2024-02-01' - 40) as date) as start,
       cast(max(date) + 3 as date) as "end" from daily""",
    "insert_if_absent": f"""with {HEADLINES}, {_new_headlines('source', 'url')}
       select source, url, ticker, title, seconds * 1000000 as published_at, publisher from fresh""",
    "insert_if_absent_small_batch": f"with {HEADLINES}, {_new_headlines('source', 'url')} {_FRESH_COLUMNS}",
    "insert_per_ticker_key": f"""with {HEADLINES}, {_new_headlines('source', 'url', 'ticker')}
       select source, url, ticker, publisher from fresh""",
    "score_per_ticker_key": f"""with {HEADLINES}, {_new_headlines('source', 'url', 'ticker').replace('from headlines', 'from doc_headlines')},
       named as (select sha256(source || chr(31) || url || chr(31) || ticker) as id, title as text from fresh),
       {_lexicon('named')} select * from lexicon_scores""",
    "insert_counts": f"""with {HEADLINES}, {_new_headlines('source', 'url')},
       watch(ticker) as (values {', '.join(f"('{name}')" for name in b.LANGUAGES)})
       select w.ticker, count(f.ticker) as inserted from watch w left join fresh f on f.ticker = w.ticker group by w.ticker""",
    "scoring_backlog": f"""with {HEADLINES} select cast(doc_id as varchar) as headline_id, ticker, title
       from doc_headlines h where not exists (select 1 from labels l where l.doc_id = h.doc_id)""",
    "write_scores_once": f"""with {LABEL_SCORES},
       batch as (
         select *, 0 as turn from label_scores
         union all
         select cast(doc_id as varchar), n_chars / 1000000.0,
                case when n_chars / 1000000.0 >= 0.05 then 'positive' else 'neutral' end, 0.5, 'lengths', 1 from documents),
       ranked as (select *, row_number() over (partition by headline_id order by turn) as place from batch)
       select headline_id, label, round(1e-9 + score, 6) as score, confidence, model from ranked r
       where place = 1 and not exists (select 1 from label_scores s where s.headline_id = r.headline_id and s.score < 1)""",
    "scored_join": f"""with {HEADLINES}, {LABEL_SCORES}
       select h.ticker, h.title, h.url, h.source, h.seconds * 1000000 as published_at, h.publisher, s.label, s.score,
              s.confidence, s.model
       from doc_headlines h join label_scores s on s.headline_id = cast(h.doc_id as varchar)""",
    "source_union": f"with {HEADLINES} select source, url, ticker, title, publisher from headlines",
    "ticker_mention_arrays": f"""with {EVENTS} select event_id, array_to_string(list_sort(list_distinct(list_filter(
         regexp_extract_all(title, '\\$([A-Z]{{1,5}})\\b', 1), lambda x: x in ('CLICK', 'ERROR', 'SIGNUP', 'VIEW')))), ',')
         as mentions from scored""",
    "mention_rows": f"""with {EVENTS}, found as (
         select distinct event_id, unnest(regexp_extract_all(title, '\\$([A-Z]{{1,5}})\\b', 1)) as ticker from scored)
       select event_id, ticker from found where ticker in ('CLICK', 'ERROR', 'SIGNUP', 'VIEW')""",
    "watchlist_parse": """select event_id, array_to_string(list_filter(list_transform(
         string_split(' ' || event_type || ', ,x' || user_id || ' ,, Spy', ','), lambda x: upper(trim(x))), lambda x: x <> ''), '|')
         as names from events""",
    "coerced_times": f"with {NEWS} select event_id, published_at from news",
    "news_normalize": f"""with {NEWS} select sha256('yfinance' || chr(31) || url) as headline_id, 'yfinance' as source,
       ticker, title, url, published_at, publisher from news where usable""",
    "forum_normalize": f"""with {FORUM} select 'reddit' as source, ticker, substring(title, 1, 500) as title, url,
       published_at, 'r/wallstreetbets' as publisher from mentions
       where ticker in ({_strings(b.LANGUAGES)})""",
    "label_thresholds": f"with {EVENTS} select event_id, label from scored",
    "prob_fold": """with p as (
         select event_id, event_type, least(value / 200.0, 0.6) as up,
                case when event_type = 'view' then least(value / 200.0, 0.6)
                     else cast(json_extract(props, '$.k') as double) / 250.0 end as down
         from events)
       select event_id, case when event_type = 'error' then null
                             when 0.15 >= greatest(up, down) then 'neutral' when up >= down then 'positive'
                             else 'negative' end as label,
              case when event_type <> 'error' then round(1e-9 + up - down, 6) end as score,
              case when event_type <> 'error' then round(1e-9 + greatest(up, down, 0.15), 6) end as confidence
       from p""",
    "lexicon_score": LEXICON,
    "lexicon_score_large": LEXICON,
    "model_score": """select cast(doc_id as varchar) as headline_id, 'positive' as label,
       round(1e-9 + 0.5 - 1.0 / (1.0 + length(text)), 6) as score, cast(0.5 as double) as confidence, 'length' as model
       from documents""",
    "model_fallback": LEXICON,
    "score_pending": f"""with {TEXTS}, {_lexicon('texts')} select * from lexicon_scores s
       where not exists (select 1 from labels l where cast(l.doc_id as varchar) = s.headline_id)""",
    "price_grid": f"with {PRICES}, {GRID} select date, ticker, round(1e-9 + close, 6) as close from grid",
    "returns": f"with {PRICES}, {RETURNS} select date, ticker, round(1e-9 + ret, 6) as ret from rets",
    "returns_unfilled": f"with {PRICES}, " + RETURNS.replace(
        "last_value(close ignore nulls) over (partition by ticker order by date rows unbounded preceding) as close",
        "close",
    ) + " select date, ticker, round(1e-9 + ret, 6) as ret from rets",
    "forward_returns": f"with {PRICES}, {RETURNS} select date, ticker, round(1e-9 + fwd_ret, 6) as fwd_ret from fwd",
    "align": f"{BACKTEST} select date, ticker, round(1e-9 + sentiment, 6) as sentiment, round(1e-9 + fwd_ret, 6) as fwd_ret from aligned",
    "universe": f"{BACKTEST} select distinct ticker from daily where ticker in (select ticker from fwd)",
    "median_split_signal": f"""{BACKTEST} select date, ticker, round(1e-9 + sentiment, 6) as sentiment,
       round(1e-9 + fwd_ret, 6) as fwd_ret, signal, round(1e-9 + signal * fwd_ret, 6) as pnl from sig""",
    "equity_curve": f"{BACKTEST} select date, round(1e-9 + pnl, 6) as pnl, round(1e-9 + equity, 6) as equity from eq",
    "backtest_metrics": f"{BACKTEST} {METRICS}",
    "backtest_by_strategy": "select 'follow' as strategy, * from (" + BACKTEST + METRICS + ") union all "
    "select 'fade' as strategy, * from ("
    + BACKTEST.replace("avg(score) as sentiment", "-avg(score) as sentiment") + METRICS + ")",
    "end_to_end": _end_to_end(),
    "dashboard": f"{_DASHBOARD} {METRICS}",
    "ingest_stream": f"""with {NEWS} select sha256('yfinance' || chr(31) || url) as headline_id,
       ticker, title, url, published_at, publisher from news where usable""",
    "ingest_score_stream": _scored_stream(),
    "rejected_lines": "select count(*) as rejected from documents where doc_id % 10 = 0",
    "daily_stream": f"with {EVENTS} {_ROUNDED_DAILY}",
    "daily_stream_closed_days": f"""with {EVENTS} {_ROUNDED_DAILY}
       where date + interval 1 day <= (select max(ts) - interval 1 day from events)""",
    "dashboard_tickers": f"with {EVENTS} select distinct ticker from scored",
    "dashboard_daily": f"""{_DASHBOARD} select ticker, date, round(1e-9 + sentiment, 6) as sentiment, n,
       cast(row_number() over (order by ticker, date) as integer) as position from daily""",
    "dashboard_feed": f"""{_DASHBOARD} select url, ticker, label, round(1e-9 + score, 6) as score,
       cast(row_number() over (order by published_at desc, url) as integer) as position
       from scored where ticker in (select ticker from chosen) order by position limit 50""",
    "dashboard_aligned": f"""{_DASHBOARD} select date, ticker, round(1e-9 + sentiment, 6) as sentiment, round(1e-9 + fwd_ret, 6) as fwd_ret,
       cast(row_number() over (order by date, ticker) as integer) as position from sig""",
    "dashboard_equity": f"""{_DASHBOARD} select date, round(1e-9 + pnl, 6) as pnl, round(1e-9 + equity, 6) as equity,
       cast(row_number() over (order by date) as integer) as position from eq""",
}
