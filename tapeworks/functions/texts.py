"""Text columns: cleaning, spam test, keyword events, engagement weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Event keywords by category, in priority order.
EVENTS = {
    "regulation": ["sec", "regulation", "ban", "compliance", "lawsuit", "enforcement", "sec charges", "regulatory"],
    "exchange": ["hack", "listing", "delisting", "withdrawal", "deposit", "exchange", "binance", "coinbase", "kraken"],
    "protocol": ["upgrade", "fork", "merge", "halving", "staking", "burn", "governance", "proposal", "vote"],
    "macro": ["fed", "interest rate", "inflation", "recession", "treasury", "cpi", "gdp", "employment"],
}

# Phrases of promotional posts.
BOT_PHRASES = ["follow me", "join now", "click here", "free money", "airdrop", "retweet to win", "like and follow", "must follow"]

# Credibility by source.
CREDIBILITY = {"reuters": 0.95, "bloomberg": 0.95, "coindesk": 0.85, "cointelegraph": 0.80, "decrypt": 0.78, "theblock": 0.82}


def clean(text: Column) -> Column:
    """Links, tickers, mentions and hashtags to plain markers, spaces folded."""
    x = F.regexp_replace(text, r"(?U)https?://\S+", "[URL]")
    x = F.regexp_replace(x, r"(?U)\$([A-Z]{2,5})\b", r"[TICKER_$1]")
    x = F.regexp_replace(x, r"(?U)@\w+", "[MENTION]")
    x = F.regexp_replace(x, r"(?U)#(\w+)", "$1")
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def is_spam(text: Column) -> Column:
    caps = F.length(F.regexp_replace(text, r"\P{Lu}", ""))
    return F.lower(text).rlike("|".join(BOT_PHRASES)) | (F.length(text) < 10) | (caps / F.greatest(F.length(text), F.lit(1)) > 0.7)


def engagement(likes: Column, reposts: Column, replies: Column, followers: Column) -> Column:
    score = likes + 3 * reposts + 2 * replies
    reach = F.least(F.log1p(followers) / 10, F.lit(1.0))
    return F.least(F.log1p(score) / 10 * (0.5 + 0.5 * reach), F.lit(1.0))


def thread_engagement(upvotes: Column, comments: Column) -> Column:
    return F.least(F.log1p(upvotes + 2 * comments) / 10, F.lit(1.0))


def credibility(source: Column) -> Column:
    x = F.lower(source)
    out = F.lit(0.50)
    for k, v in CREDIBILITY.items():
        out = F.when(x == k, v).otherwise(out)
    return out


def event_categories(low: Column) -> Column:
    """Matched categories of lower-cased text in priority order (the first is the
    primary one)."""
    hits = []
    for cat, words in EVENTS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        hits.append(F.when(hit, F.lit(cat)))
    return F.array_compact(F.array(*hits))
