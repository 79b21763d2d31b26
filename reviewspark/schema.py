"""Explicit schemas, so that no file decides the types of the next one."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _LONG, _BOOL, _DOUBLE = T.StringType(), T.LongType(), T.BooleanType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Column names and types of the flat reviews table.
REVIEWS = _struct(
    name=_STRING,
    steam_appid=_LONG,
    required_age=_LONG,
    is_free=_BOOL,
    controller_support=_STRING,
    detailed_description=_STRING,
    about_the_game=_STRING,
    short_description=_STRING,
    price_overview=_STRING,
    metacritic_score=_LONG,
    categories=T.ArrayType(_STRING),
    genres=T.ArrayType(_STRING),
    recommendations=_LONG,
    achievements=_LONG,
    release_coming_soon=_BOOL,
    release_date=_STRING,
    review_language=_STRING,
    author_steamid=_STRING,
    author_num_games_owned=_LONG,
    author_num_reviews=_LONG,
    author_playtime_forever=_LONG,
    author_play_time_last_two_weeks=_LONG,
    author_playtime_at_review=_LONG,
    author_last_played=_LONG,
    review=_STRING,
    voted_up=_BOOL,
    votes_up=_LONG,
    votes_funny=_LONG,
    weighted_vote_score=_DOUBLE,
)

# The columns the theme report reads.
REPORT_INPUT = ["steam_appid", "review", "review_language", "voted_up"]

# Columns that may name the product, best first.
NAME_COLUMNS = ["name", "game_name", "title", "short_description", "about_the_game"]

# The text columns that are cleaned of markup.
MARKUP_COLUMNS = ["detailed_description", "about_the_game", "short_description", "review"]

_REVIEW_NODE = _struct(
    language=_STRING,
    review=_STRING,
    voted_up=_BOOL,
    votes_up=_LONG,
    votes_funny=_LONG,
    weighted_vote_score=_STRING,
    author=_struct(
        steamid=_STRING,
        num_games_owned=_LONG,
        num_reviews=_LONG,
        playtime_forever=_LONG,
        playtime_last_two_weeks=_LONG,
        playtime_at_review=_LONG,
        last_played=_LONG,
    ),
)

_PRODUCT_NODE = _struct(
    name=_STRING,
    steam_appid=_LONG,
    required_age=_STRING,
    is_free=_BOOL,
    controller_support=_STRING,
    detailed_description=_STRING,
    about_the_game=_STRING,
    short_description=_STRING,
    price_overview=_struct(final_formatted=_STRING),
    metacritic=_struct(score=_LONG),
    categories=T.ArrayType(_struct(description=_STRING)),
    genres=T.ArrayType(_struct(description=_STRING)),
    recommendations=_struct(total=_LONG),
    achievements=_struct(total=_LONG),
    release_date=_struct(coming_soon=_BOOL, date=_STRING),
    review_stats=_struct(total_num_reviews=_LONG, reviews=T.ArrayType(_REVIEW_NODE)),
)

# One raw document: the product id is the key, not a field.
RAW_DOCUMENT = T.MapType(_STRING, _struct(success=_BOOL, data=_PRODUCT_NODE))

# The theme file: product id -> theme -> seed words, themes in file order.
THEME_FILE = T.MapType(_STRING, T.MapType(_STRING, T.ArrayType(_STRING)))

# Names under which the report is delivered, in order.
REPORT_NAMES = {
    "app_id": "steam_appid",
    "theme": "Theme",
    "review_count": "#Reviews",
    "positive": "Positive",
    "negative": "Negative",
    "like_ratio": "LikeRatio",
    "dislike_ratio": "DislikeRatio",
    "positive_reviews": "Positive_Reviews",
    "negative_reviews": "Negative_Reviews",
    "positive_summary": "Positive_Summary",
    "negative_summary": "Negative_Summary",
}
