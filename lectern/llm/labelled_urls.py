"""Labelled URLs for the filter, made by rule from a seed, and how often words occur.

A URL has a topic; its host joins words of the topic and common ones, as sites
are named, and its path has words of it, numbers and the usual endings.  Some
words of topics are from the other side, as news on a casino and shops for
pills exist.  Common words, sections, languages and unreadable names come on
both sides alike.
"""

from __future__ import annotations

import random

# Common words, the most frequent first.
COMMON = ["the", "of", "and", "to", "in", "a", "for", "is", "on", "by", "with", "you", "it", "not", "or", "be", "are", "from", "at", "as", "your", "all", "have", "new", "more", "an", "was", "we", "will", "home", "can", "us", "about", "my", "page", "has", "free", "but", "our", "one", "other", "do", "no", "time", "they", "site", "he", "up", "may", "what", "which", "their", "news", "out", "use", "any", "there", "see", "only", "so", "his", "when", "contact", "here", "who", "web", "also", "now", "help", "get", "view", "online", "first", "been", "would", "how", "were", "services", "some", "these", "click", "its", "like", "service", "than", "find", "date", "back", "top", "people", "had", "list", "name", "just", "over", "state", "year", "day", "into", "two", "world", "next", "go", "work", "last", "most", "make", "them", "should", "city", "good", "best", "well", "where", "info", "high", "through", "each", "very", "life", "know", "way", "daily", "live", "big", "old", "house", "great", "real", "local", "group", "place", "man", "little", "water", "long", "right", "blue", "red", "green", "black", "white", "north", "south", "east", "west", "house", "street", "times", "post", "express", "hub", "zone", "point", "land", "club", "central", "direct", "guide", "start"]
SHARED = ["www", "m", "blog", "en", "de", "fr", "es", "index", "html", "htm", "php", "page", "net", "com", "org", "info", "example", "archive", "category", "article", "item", "id", "p", "post", "tag", "shop", "static", "news", "forum"]
BLOCK_TOPICS = {
    "gambling": ["casino", "poker", "slots", "slot", "bet", "betting", "bets", "odds", "jackpot", "roulette", "blackjack", "bingo", "lottery", "wager", "spins", "bonus", "gambling", "baccarat", "bookmaker", "lotto"],
    "adult": ["porn", "sex", "xxx", "nude", "escort", "escorts", "cam", "cams", "erotic", "adult", "milf", "hookup", "fetish", "naked", "hentai", "webcam", "sexy", "dating", "girls", "hot"],
    "pills": ["pills", "viagra", "cialis", "pharmacy", "prescription", "tramadol", "xanax", "meds", "steroids", "slimming", "keto", "detox", "enlargement", "levitra", "cheap", "pill", "diet", "miracle", "fat", "burner"],
    "money": ["loan", "loans", "payday", "cash", "rich", "forex", "binary", "bitcoin", "crypto", "doubler", "profit", "invest", "earn", "income", "debt", "credit", "fast", "quick", "money", "guaranteed"],
    "fakes": ["replica", "replicas", "fake", "counterfeit", "rolex", "handbags", "knockoff", "outlet", "discount", "wholesale", "luxury", "watches", "diploma", "passport", "essay", "papers"],
    "piracy": ["torrent", "torrents", "warez", "crack", "cracked", "keygen", "serial", "pirate", "nulled", "rip", "hdrip", "streaming", "putlocker", "mp3", "hack", "cheats", "generator", "unlimited"],
    "scams": ["winner", "win", "prize", "prizes", "giveaway", "claim", "gift", "survey", "reward", "rewards", "congratulations", "lucky", "urgent", "verify", "clickbait", "spam"],
    "ads": ["ads", "adserver", "banner", "popunder", "tracker", "tracking", "pixel", "doubleclick", "affiliate", "clicks", "impressions", "redirect", "traffic", "backlinks", "seo", "popup"],
}
ALLOW_TOPICS = {
    "news": ["politics", "election", "reporter", "headlines", "opinion", "editor", "press", "journal", "tribune", "gazette", "herald", "bulletin", "weather", "forecast", "breaking", "interview"],
    "science": ["science", "research", "physics", "biology", "chemistry", "paper", "study", "laboratory", "genome", "climate", "space", "planet", "theory", "data", "journal", "institute"],
    "school": ["university", "school", "college", "student", "students", "teacher", "course", "lesson", "learning", "exam", "library", "education", "campus", "degree", "lecture", "academy"],
    "health": ["health", "hospital", "doctor", "clinic", "patient", "nurse", "medicine", "disease", "care", "symptoms", "vaccine", "heart", "cancer", "therapy", "mental", "dental"],
    "tech": ["software", "computer", "code", "python", "linux", "developer", "tutorial", "docs", "api", "cloud", "network", "mobile", "open", "source", "database", "machine"],
    "travel": ["travel", "hotel", "flight", "beach", "mountain", "island", "tour", "trip", "museum", "map", "holiday", "photos", "camping", "airport", "train", "tourism"],
    "food": ["recipe", "recipes", "kitchen", "cooking", "food", "bread", "soup", "cake", "cheese", "wine", "coffee", "restaurant", "chef", "salad", "chicken", "vegetable"],
    "sports": ["sports", "football", "soccer", "tennis", "league", "team", "match", "player", "coach", "olympic", "cycling", "running", "basketball", "stadium", "results", "golf"],
    "public": ["government", "council", "court", "law", "tax", "police", "parliament", "ministry", "permit", "public", "census", "policy", "village", "county", "library", "rights"],
    "arts": ["music", "art", "artist", "gallery", "theatre", "film", "cinema", "concert", "band", "poetry", "novel", "painting", "history", "books", "album", "dance"],
    "home": ["garden", "flowers", "furniture", "bedroom", "decor", "family", "baby", "kids", "pets", "dog", "cat", "fashion", "style", "craft", "knitting", "repair"],
    "trade": ["business", "company", "market", "finance", "bank", "insurance", "jobs", "career", "office", "industry", "store", "product", "products", "review", "reviews", "support"],
}
ENDINGS = ["com", "net", "org", "info", "co.uk", "de", "io"]
LETTERS = "etaoinshrdlucmfwypvbgk"


def forms(word: str) -> list[str]:
    """A word and what it becomes by the rules of plural, -ing and -er."""
    if len(word) < 4 or word.endswith("s"):
        return [word]
    stem = word[:-1] if word.endswith("e") else word
    return [word, word[:-1] + "ies" if word.endswith("y") else word + "s", stem + "ing", stem + "er"]


def common_counts(total: int = 60_000) -> dict[str, int]:
    """How often common words occur in so many, by Zipf's law."""
    ranked = list(dict.fromkeys(COMMON))
    scale = total / sum(1 / (i + 1) for i in range(len(ranked)))
    return {w: max(1, round(scale / (i + 1))) for i, w in enumerate(ranked)}


def made_url(rng: random.Random, block: bool) -> tuple[list[str], list[str], str]:
    """(words of the host, words of the path, the URL) of one side."""
    mine, others = (BLOCK_TOPICS, ALLOW_TOPICS) if block else (ALLOW_TOPICS, BLOCK_TOPICS)
    topic = rng.choice(list(mine.values()))

    def word() -> str:
        chance = rng.random()
        if chance < 0.7:
            return rng.choice(forms(rng.choice(topic)))
        if chance < 0.73:
            return rng.choice(forms(rng.choice(rng.choice(list(others.values())))))
        return rng.choice(COMMON)

    def unreadable() -> str:
        return "".join(rng.choices(LETTERS, weights=range(len(LETTERS), 0, -1), k=rng.randint(3, 11)))

    sub = rng.choice([[], [], ["www"], ["www"], ["m"], ["blog"], ["shop"], ["static"]])
    name = [unreadable()] if rng.random() < 0.2 else [word() for _ in range(rng.choice([1, 2, 2, 3]))]
    ending = rng.choice(ENDINGS)
    host = ".".join([*sub, rng.choice(["", "", "", "-"]).join(name), *(["example"] if rng.random() < 0.1 else []), ending])
    path, text = [], ""
    for _ in range(rng.choice([0, 1, 1, 2, 3])):
        held = [rng.choice(SHARED)] if rng.random() < 0.35 else [str(rng.randint(1, 9999))] if rng.random() < 0.25 else [unreadable()] if rng.random() < 0.1 else [word() for _ in range(rng.choice([1, 2, 3, 4]))]
        path += held
        text += "/" + rng.choice(["-", "-", "_", ""]).join(held)
    if text and rng.random() < 0.3:
        path.append("html")
        text += ".html"
    return [*sub, *name, *ending.split(".")], path, f"https://{host}{text or '/'}"


def labelled_urls(n: int = 12_000, block_share: float = 0.25, seed: int = 3) -> list[tuple[list[str], bool]]:
    """(words, whether it is to be blocked) of so many URLs, one in four of them to be blocked."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        block = rng.random() < block_share
        host, path, _ = made_url(rng, block)
        out.append(([*host, *path], block))
    return out
