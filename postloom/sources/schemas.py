"""Fixed schemas: raw platform payloads (read with these, so missing keys are
NULL) and the stored tables."""

from __future__ import annotations

TWITTER_RAW = (
    "id long, id_str string, text string, full_text string, created_at string, lang string, "
    "user struct<id: long, id_str: string, screen_name: string, name: string, followers_count: long>, "
    "public_metrics struct<like_count: long, reply_count: long, retweet_count: long, impression_count: long>, "
    "favorite_count long, reply_count long, retweet_count long, "
    "referenced_tweets array<struct<type: string, id: string>>, entities struct<media: array<string>>, "
    "extended_entities string, in_reply_to_status_id string, in_reply_to_user_id string, retweeted_status string"
)

REDDIT_RAW = (
    "id string, title string, selftext string, "
    "author struct<name: string, link_karma: long, comment_karma: long>, "
    "ups long, num_comments long, is_self boolean, created_utc double, subreddit string, permalink string, "
    "score long, url string"
)

BLUESKY_RAW = (
    "uri string, record struct<text: string, created_at: string, langs: array<string>, reply: string, "
    "embed: struct<images: string, external: string>>, "
    "author struct<did: string, handle: string, display_name: string, followers_count: long>, "
    "like_count long, reply_count long, repost_count long, reason struct<py_type: string>"
)

RAW = {"twitter": TWITTER_RAW, "reddit": REDDIT_RAW, "bluesky": BLUESKY_RAW}

POST_COLUMNS = [
    ("post_id", "string"), ("platform", "string"), ("platform_url", "string"), ("text", "string"),
    ("language", "string"), ("author_id", "string"), ("author_username", "string"),
    ("author_display_name", "string"), ("author_followers", "long"), ("like_count", "long"),
    ("reply_count", "long"), ("retweet_count", "long"), ("view_count", "long"), ("is_reply", "boolean"),
    ("is_repost", "boolean"), ("has_media", "boolean"), ("created_at", "timestamp"),
    ("scraped_at", "timestamp"), ("sentiment", "string"), ("category", "string"), ("raw_json", "string"),
]
POSTS = ", ".join(f"{n} {t}" for n, t in POST_COLUMNS)

POST_HASHTAGS = "platform string, post_id string, hashtag string"
SCRAPER_STATE = ("platform string, query string, last_post_id string, last_timestamp timestamp, cursor string, "
                 "updated_at timestamp")
SYNTHETIC_POSTS = ("platform string, text string, model string, model_family string, cost_usd double, "
                   "input_tokens long, output_tokens long, generated_at timestamp, text_length long, is_synthetic int")
CLEANED_POSTS = ("platform string, post_id string, original_text string, cleaned_text string, label int, "
                 "split_group string, input_ids array<int>, attention_mask array<int>, embeddings array<float>")
RAW_FEATURES = ("platform string, post_id string, split_group string, label int, perplexity double, "
                "burstiness double, punctuation_density double, lexical_diversity double")
RUN_LOG = "run_id string, platform string, query string, status string, posts long, started_at timestamp"
