"""Fixed schemas of the records that the library reads, as DDL."""

from __future__ import annotations

TWEET = (
    "id_str string, text string, created_at string, "
    "user struct<id_str:string,screen_name:string,lang:string,statuses_count:bigint>, "
    "entities struct<hashtags:array<struct<text:string>>>, geo struct<coordinates:array<double>>"
)
FOLLOWER = "user_id decimal(20,0), follower_id decimal(20,0), pos bigint"
JOB = "op string, user_id bigint, cursor string"
METRIC = "label string, value bigint, ts timestamp"
ANNOTATION = "id string, tweet string, hts array<string>, annotations array<struct<id:bigint,rho:double,title:string>>"
PAGE = "id bigint, ns int, revid bigint, length bigint, touched string, title string, name string"
WIKI_PAGE = (
    f"{PAGE}, html string, links array<struct<{PAGE.replace(' ', ':').replace(',:', ',')}>>, "
    f"templates array<struct<{PAGE.replace(' ', ':').replace(',:', ',')}>>, "
    f"categories array<struct<{PAGE.replace(' ', ':').replace(',:', ',')}>>"
)
ANCHOR = "anchor string, pages array<struct<title:string,cnt:bigint>>"
SENTIMENT_LEXICON = "pos string, offset int, pos_score double, neg_score double, synset_terms string, gloss string"
