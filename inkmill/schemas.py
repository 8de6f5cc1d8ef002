"""Spark types of the records, as DDL."""

COSTS = "map<string, double>"
SAVINGS = f"struct<original_tokens: bigint, optimized_tokens: bigint, tokens_saved: bigint, savings_percentage: double, original_words: bigint, optimized_words: bigint, cost_saved: {COSTS}>"
TOKENS = f"tokens: bigint, encoding: string, legacy_tokens: bigint, words: bigint, chars: bigint, tokens_per_word: double, estimated_costs: {COSTS}"
STATS = f"struct<{TOKENS}, headers: bigint, links: bigint, images: bigint, table_rows: bigint, lines: bigint, reading_time_minutes: bigint, savings: {SAVINGS}>"
ANALYSIS = f"struct<{TOKENS}>"
META = "struct<title: string, description: string, headings: array<struct<level: int, text: string>>, keywords: array<string>, estimated_tokens: bigint>"
OPTIMIZED = f"struct<markdown: string, body: string, savings: {SAVINGS}, meta: {META}>"
COUNTED = f"{OPTIMIZED[:-1]}, tokens: bigint>"
ENTITY = "struct<type: string, original: string, placeholder: string>"
ANONYMIZED = f"struct<text: string, entities: array<{ENTITY}>, total: bigint, by_type: map<string, bigint>, originals: map<string, string>>"
CHUNK = "struct<id: string, doc_id: string, doc_title: string, chunk_index: int, title: string, breadcrumbs: array<string>, content: string, embedding_text: string, token_count: bigint, char_count: bigint>"
CHUNKS = f"array<{CHUNK}>"
CONVERTED = "struct<format: string, markdown: string, pages: int, warnings: array<string>, error: string>"
SECTIONS = "array<struct<title: string, breadcrumbs: array<string>, content: string, tokens: bigint>>"
