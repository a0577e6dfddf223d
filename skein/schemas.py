"""Explicit schemas of every table the jobs read or write (no inference)."""

from pyspark.sql import types as T

# Raw dump lines (one JSON object per line). Field presence matters for some
# columns, so every field is nullable and presence is checked on the raw text.
RAW_POST = T.StructType([
    T.StructField("author", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("created_utc", T.LongType()),
    T.StructField("selftext", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("link_flair_text", T.StringType()),
    T.StructField("distinguished", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("permalink", T.StringType()),
    T.StructField("link_id", T.StringType()),
])

RAW_REPLY = T.StructType([
    T.StructField("author", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("created_utc", T.LongType()),
    T.StructField("body", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("distinguished", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("permalink", T.StringType()),
    T.StructField("link_id", T.StringType()),
])

# Flat CSV interchange (what the export writes and the thread builder reads).
POST_CSV = T.StructType([
    T.StructField("author", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("created", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("link_flair_text", T.StringType()),
    T.StructField("distinguished", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("link", T.StringType()),
])

REPLY_CSV = T.StructType([
    T.StructField("author", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("created", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("distinguished", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("link", T.StringType()),
])

# Typed tables the tree jobs work on. ``ord`` is the position in the input
# (file order), the last tie-break of every ordering.
POSTS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("created", T.TimestampType()),
    T.StructField("body", T.StringType()),
    T.StructField("link_flair_text", T.StringType()),
    T.StructField("distinguished", T.StringType()),
    T.StructField("ord", T.LongType()),
])

REPLIES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("created", T.TimestampType()),
    T.StructField("body", T.StringType()),
    T.StructField("distinguished", T.StringType()),
    T.StructField("ord", T.LongType()),
])

THREADS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("post_id", T.StringType()),
    T.StructField("full_thread", T.StringType()),
    T.StructField("subthread", T.StringType()),
    T.StructField("subthread_context", T.StringType()),
])

EXAMPLES = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("reasoning", T.StringType()),
    T.StructField("answer", T.StringType()),
])

CORPUS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("thread", T.StringType()),
    T.StructField("embeddings", T.ArrayType(T.DoubleType())),
])

# Model answers arrive as a table instead of a network call.
RESPONSES = T.StructType([
    T.StructField("thread_id", T.StringType()),
    T.StructField("j", T.IntegerType()),
    T.StructField("stage", T.StringType()),      # 'question' | 'answer'
    T.StructField("attempt", T.IntegerType()),   # 0-based
    T.StructField("text", T.StringType()),
])

CONVERSATIONS = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])
