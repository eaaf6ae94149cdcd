"""A projection of the driver's tables to messages, labels and hints, in SQL that Spark and DuckDB both run.

Raw texts of the tables are invented prose without any support vocabulary, so each message takes a canned phrase of its
side, picked by its place.
"""

from __future__ import annotations

BRAND = "brand"
CUSTOMER = [
    "My offline songs vanished", "Cheers, got it", "That worked", "Thanks but it keeps crashing, any update", "It hasn’t been fixed",
    "Works fine, thank you", "DMed you the details", "Okay, on Tuesday then", "Thanks anyway", "Thank you",
    "Thanks for the long story about my weekend and the new speakers that arrived on Monday morning", "Still can't log in", "Where is my playlist?",
    "Perfect, all good now", "I sent you the screenshots", "Thanks a lot @brand https://t.co/x1", "It's still not solved", "   ",
]
REPLIES = [
    "Drop us a DM", "We've fixed that, DM us for details", "Over to DM for the account details", "Unfortunately that album was removed",
    "We can't wait to hear more", "Anytime, enjoy the music", "Great! Let us know if you need anything else", "Could you tell us the model",
    "We'll look into it", "Which phone is it?", "Please reinstall the player.", "It should be working again", "We can't offer refunds",
    "Just let us know if there is anything else", "We'll pass this on to the right team",
]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pick(name: str, phrases: list[str]) -> str:
    return f"{name}(k, phrase) AS (VALUES " + ", ".join(f"({i}, {quoted(p)})" for i, p in enumerate(phrases)) + ")"


#: conv_id, turn, side, text of all customer and brand messages.
MESSAGES = f"""
    {_pick("customer_said", CUSTOMER)}, {_pick("brand_said", REPLIES)},
    messages AS (
        SELECT c.conv_id, c.turn, CASE WHEN c.role = 'assistant' THEN 'brand' ELSE 'customer' END AS side,
               CASE WHEN c.role = 'assistant' THEN b.phrase ELSE u.phrase END AS text
        FROM conversations c
        JOIN customer_said u ON u.k = (c.conv_id * 7 + c.turn) % {len(CUSTOMER)}
        JOIN brand_said b ON b.k = (c.conv_id * 7 + c.turn) % {len(REPLIES)}
        WHERE c.role IN ('user', 'assistant'))"""

#: The reply graph of all conversations: system rows are a third party. In every sixth one the third message answers the first, unseen by
#: the brand, and the fifth answers that: an opening inside another's dyad.
TWEETS = f"""
    {_pick("customer_said", CUSTOMER)}, {_pick("brand_said", REPLIES)},
    tweets AS (
        SELECT c.conv_id * 100 + c.turn AS tweet_id,
               CASE c.role WHEN 'assistant' THEN 'brand' WHEN 'user' THEN concat('cust_', CAST(c.conv_id AS VARCHAR(20))) ELSE concat('sys_', CAST(c.conv_id AS VARCHAR(20))) END AS author_id,
               c.role <> 'assistant' AS inbound,
               CAST(1509494400 + c.conv_id * 1000 + c.turn * 60 AS BIGINT) AS created_at,
               CASE WHEN c.role = 'assistant' THEN b.phrase WHEN c.conv_id % 6 = 0 AND c.turn = 2 THEN u.phrase WHEN c.conv_id % 3 = 0 THEN concat('@Brand ', u.phrase)
                    WHEN c.conv_id % 3 = 1 THEN concat('@BrandHelp ', u.phrase) ELSE u.phrase END AS text,
               CASE WHEN c.conv_id % 6 = 0 AND c.turn IN (2, 3) THEN c.conv_id * 100 WHEN c.conv_id % 6 = 0 AND c.turn = 4 THEN c.conv_id * 100 + 2
                    WHEN c.turn > 0 THEN c.conv_id * 100 + c.turn - 1 END AS parent_id
        FROM conversations c
        JOIN customer_said u ON u.k = (c.conv_id * 7 + c.turn) % {len(CUSTOMER)}
        JOIN brand_said b ON b.k = (c.conv_id * 7 + c.turn) % {len(REPLIES)})"""
