"""Model price, cache-price and context-limit tables."""

from __future__ import annotations

# USD per million tokens as (prompt, completion), in matching order.
PRICES = {
    "8k": (30, 60), "32k": (60, 120), "4k": (1.5, 2), "16k": (3, 4), "gpt-3.5-turbo-1106": (1, 2),
    "o4-mini": (1.1, 4.4), "o3-mini": (1.1, 4.4), "o3": (2, 8), "o1-mini": (1.1, 4.4), "o1-preview": (15, 60),
    "o1": (15, 60), "gpt-4.1-nano": (0.1, 0.4), "gpt-4.1-mini": (0.4, 1.6), "gpt-4.1": (2, 8), "gpt-4.5": (75, 150),
    "gpt-4o-mini": (0.15, 0.6), "gpt-5": (1.25, 10), "gpt-5-mini": (0.25, 2), "gpt-5-nano": (0.05, 0.4),
    "gpt-4o": (2.5, 10), "gpt-4o-2024-05-13": (5, 15), "gpt-4-1106": (10, 30), "gpt-3.5-turbo-0125": (0.5, 1.5),
    "claude-3-opus": (15, 75), "claude-3-sonnet": (3, 15), "claude-3-5-sonnet": (3, 15), "claude-3.5-sonnet": (3, 15),
    "claude-3-7-sonnet": (3, 15), "claude-3.7-sonnet": (3, 15), "claude-3-5-haiku": (0.8, 4),
    "claude-3.5-haiku": (0.8, 4), "claude-3-haiku": (0.25, 1.25), "claude-sonnet-4": (3, 15), "claude-opus-4": (15, 75),
    "claude-2.1": (8, 24), "claude-2": (8, 24), "claude-instant": (0.8, 2.4), "claude-": (0.8, 2.4),
    "command-r-plus": (3, 15), "command-r": (0.5, 1.5), "deepseek-reasoner": (0.55, 2.19), "deepseek": (0.14, 0.28),
    "command": (0.38, 0.38), "gemma": (0, 0), "gemma-2": (0, 0), "gemma-3": (0, 0), "gemma-3-27b": (0, 0),
    "gemini-2.0-flash-lite": (0.075, 0.3), "gemini-2.0-flash": (0.1, 0.4), "gemini-2.0": (0, 0),
    "gemini-2.5-pro": (1.25, 10), "gemini-2.5-flash": (0.15, 3.5), "gemini-2.5": (0, 0),
    "gemini-1.5-flash-8b": (0.075, 0.3), "gemini-1.5-flash": (0.15, 0.6), "gemini-1.5": (2.5, 10),
    "gemini-pro-vision": (0.5, 1.5), "gemini": (0.5, 1.5), "grok-2-vision-1212": (2, 10),
    "grok-2-vision-latest": (2, 10), "grok-2-vision": (2, 10), "grok-vision-beta": (5, 15), "grok-2-1212": (2, 10),
    "grok-2-latest": (2, 10), "grok-2": (2, 10), "grok-3-mini-fast": (0.6, 4), "grok-3-mini": (0.3, 0.5),
    "grok-3-fast": (5, 25), "grok-3": (3, 15), "grok-4": (3, 15), "grok-beta": (5, 15), "mistral-large": (2, 6),
    "pixtral-large": (2, 6), "mistral-saba": (0.2, 0.6), "codestral": (0.3, 0.9), "ministral-8b": (0.1, 0.1),
    "ministral-3b": (0.04, 0.04), "gpt-oss-20b": (0.05, 0.2), "gpt-oss-120b": (0.15, 0.6), "llama2-13b": (0.75, 1),
    "llama2:13b": (0.75, 1), "llama2:70b": (1.95, 2.56), "llama2-70b": (1.95, 2.56), "llama3-8b": (0.3, 0.6),
    "llama3:8b": (0.3, 0.6), "llama3-70b": (2.65, 3.5), "llama3:70b": (2.65, 3.5), "llama3-1-8b": (0.22, 0.22),
    "llama3-1-70b": (0.72, 0.72), "llama3-1-405b": (2.4, 2.4), "llama3-2-1b": (0.1, 0.1), "llama3-2-3b": (0.15, 0.15),
    "llama3-2-11b": (0.16, 0.16), "llama3-2-90b": (0.72, 0.72), "llama3.1:8b": (0.22, 0.22),
    "llama3.1:70b": (0.72, 0.72), "llama3.1:405b": (2.4, 2.4), "llama3.2:1b": (0.1, 0.1), "llama3.2:3b": (0.15, 0.15),
    "llama3.2:11b": (0.16, 0.16), "llama3.2:90b": (0.72, 0.72), "llama-3.1-8b": (0.22, 0.22),
    "llama-3.1-70b": (0.72, 0.72), "llama-3.1-405b": (2.4, 2.4), "llama-3.2-1b": (0.1, 0.1),
    "llama-3.2-3b": (0.15, 0.15), "llama-3.2-11b": (0.16, 0.16), "llama-3.2-90b": (0.72, 0.72),
    "llama-3.3-70b": (2.65, 3.5), "mistral-7b": (0.15, 0.2), "mistral-small": (0.15, 0.2), "mixtral-8x7b": (0.45, 0.7),
    "mistral-large-2402": (4, 12), "mistral-large-2407": (3, 9), "command-text": (1.5, 2), "command-light": (0.3, 0.6),
    "ai21.j2-mid-v1": (12.5, 12.5), "ai21.j2-ultra-v1": (18.8, 18.8), "ai21.jamba-instruct-v1:0": (0.5, 0.7),
    "amazon.titan-text-lite-v1": (0.15, 0.2), "amazon.titan-text-express-v1": (0.2, 0.6),
    "amazon.titan-text-premier-v1:0": (0.5, 1.5), "amazon.nova-micro-v1:0": (0.035, 0.14),
    "amazon.nova-lite-v1:0": (0.06, 0.24), "amazon.nova-pro-v1:0": (0.8, 3.2), "deepseek.r1": (1.35, 5.4),
}

# USD per million cached tokens as (write, read).
CACHE_PRICES = {
    "claude-3.7-sonnet": (3.75, 0.3), "claude-3-7-sonnet": (3.75, 0.3), "claude-3.5-sonnet": (3.75, 0.3),
    "claude-3-5-sonnet": (3.75, 0.3), "claude-3.5-haiku": (1, 0.08), "claude-3-5-haiku": (1, 0.08),
    "claude-3-haiku": (0.3, 0.03), "claude-sonnet-4": (3.75, 0.3), "claude-opus-4": (18.75, 1.5),
}

# Fixed values: (part of the model name, billing key), first match wins.
KEY_RULES = [
    ("gpt-3.5-turbo-16k", "16k"), ("gpt-3.5-turbo-0125", "gpt-3.5-turbo-0125"),
    ("gpt-3.5-turbo-1106", "gpt-3.5-turbo-1106"), ("gpt-3.5", "4k"), ("o4-mini", "o4-mini"), ("o4", "o4"),
    ("o3-mini", "o3-mini"), ("o3", "o3"), ("o1-preview", "o1-preview"), ("o1-mini", "o1-mini"), ("o1", "o1"),
    ("gpt-4.5", "gpt-4.5"), ("gpt-4.1-nano", "gpt-4.1-nano"), ("gpt-4.1-mini", "gpt-4.1-mini"), ("gpt-4.1", "gpt-4.1"),
    ("gpt-4o-2024-05-13", "gpt-4o-2024-05-13"), ("gpt-5-nano", "gpt-5-nano"), ("gpt-5-mini", "gpt-5-mini"),
    ("gpt-5", "gpt-5"), ("gpt-4o-mini", "gpt-4o-mini"), ("gpt-4o", "gpt-4o"), ("gpt-4-vision", "gpt-4-1106"),
    ("gpt-4-1106", "gpt-4-1106"), ("gpt-4-0125", "gpt-4-1106"), ("gpt-4-turbo", "gpt-4-1106"), ("gpt-4-32k", "32k"),
    ("gpt-4", "8k"),
]

# Context limits of all model families, in matching order (the last contained name wins).
CONTEXT_LIMITS = {
    "o4-mini": 200000, "o3-mini": 195000, "o3": 200000, "o1": 195000, "o1-mini": 127500, "o1-preview": 127500,
    "gpt-4": 8187, "gpt-4-0613": 8187, "gpt-4-32k": 32758, "gpt-4-32k-0314": 32758, "gpt-4-32k-0613": 32758,
    "gpt-4-1106": 127500, "gpt-4-0125": 127500, "gpt-4.5": 127500, "gpt-4.1": 1047576, "gpt-4.1-mini": 1047576,
    "gpt-4.1-nano": 1047576, "gpt-5": 400000, "gpt-5-mini": 400000, "gpt-5-nano": 400000, "gpt-4o": 127500,
    "gpt-4o-mini": 127500, "gpt-4o-2024-05-13": 127500, "gpt-4o-2024-08-06": 127500, "gpt-4-turbo": 127500,
    "gpt-4-vision": 127500, "gpt-3.5-turbo": 16375, "gpt-3.5-turbo-0613": 4092, "gpt-3.5-turbo-0301": 4092,
    "gpt-3.5-turbo-16k": 16375, "gpt-3.5-turbo-16k-0613": 16375, "gpt-3.5-turbo-1106": 16375,
    "gpt-3.5-turbo-0125": 16375, "gemma": 8196, "gemma-2": 32768, "gemma-3": 32768, "gemma-3-27b": 131072,
    "gemini": 30720, "gemini-pro-vision": 12288, "gemini-exp": 2000000, "gemini-2.5": 1000000,
    "gemini-2.5-pro": 1000000, "gemini-2.5-flash": 1000000, "gemini-2.0": 2000000, "gemini-2.0-flash": 1000000,
    "gemini-2.0-flash-lite": 1000000, "gemini-1.5": 1000000, "gemini-1.5-flash": 1000000,
    "gemini-1.5-flash-8b": 1000000, "text-bison-32k": 32758, "chat-bison-32k": 32758, "code-bison-32k": 32758,
    "codechat-bison-32k": 32758, "code-": 6139, "codechat-": 6139, "text-": 8187, "chat-": 8187, "claude-": 100000, "claude-instant": 100000, "claude-2": 100000,
    "claude-2.1": 200000, "claude-3": 200000, "claude-3-haiku": 200000, "claude-3-sonnet": 200000,
    "claude-3-opus": 200000, "claude-3.5-haiku": 200000, "claude-3-5-haiku": 200000, "claude-3-5-sonnet": 200000,
    "claude-3.5-sonnet": 200000, "claude-3-7-sonnet": 200000, "claude-3.7-sonnet": 200000,
    "claude-3-5-sonnet-latest": 200000, "claude-3.5-sonnet-latest": 200000, "claude-sonnet-4": 1000000,
    "claude-opus-4": 200000, "claude-4": 200000, "mistral-": 31990, "mistral-7b": 31990, "mistral-small": 31990,
    "mixtral-8x7b": 31990, "mistral-large": 131000, "mistral-large-2402": 127500, "mistral-large-2407": 127500,
    "pixtral-large": 131000, "mistral-saba": 32000, "codestral": 256000, "ministral-8b": 131000,
    "ministral-3b": 131000, "command-light": 4086, "command-light-nightly": 8182, "command": 4086,
    "command-nightly": 8182, "command-r": 127500, "command-r-plus": 127500, "qwen2.5": 32000,
    "deepseek-reasoner": 63000, "deepseek": 63000, "deepseek.r1": 127500, "llama3": 8000, "llama2": 4000,
    "llama-3": 8000, "llama-2": 4000, "llama3.1": 127500, "llama3.2": 127500, "llama3.3": 127500, "llama3-1": 127500,
    "llama3-2": 127500, "llama3-3": 127500, "llama-3.1": 127500, "llama-3.2": 127500, "llama-3.3": 127500,
    "llama3.1:405b": 127500, "llama3.1:70b": 127500, "llama3.1:8b": 127500, "llama3.2:1b": 127500,
    "llama3.2:3b": 127500, "llama3.2:11b": 127500, "llama3.2:90b": 127500, "llama3.3:70b": 127500,
    "llama3-1-405b": 127500, "llama3-1-70b": 127500, "llama3-1-8b": 127500, "llama3-2-1b": 127500,
    "llama3-2-3b": 127500, "llama3-2-11b": 127500, "llama3-2-90b": 127500, "llama3-3-70b": 127500,
    "llama-3.1-405b": 127500, "llama-3.1-70b": 127500, "llama-3.1-8b": 127500, "llama-3.2-1b": 127500,
    "llama-3.2-3b": 127500, "llama-3.2-11b": 127500, "llama-3.2-90b": 127500, "llama-3.3-70b": 127500,
    "llama3-70b": 8000, "llama3-8b": 8000, "llama2-70b": 4000, "llama2-13b": 4000, "llama3:70b": 8000,
    "llama3:8b": 8000, "llama2:70b": 4000, "ai21.j2-mid-v1": 8182, "ai21.j2-ultra-v1": 8182,
    "ai21.jamba-instruct-v1:0": 255500, "amazon.titan-text-lite-v1": 4000, "amazon.titan-text-express-v1": 8000,
    "amazon.titan-text-premier-v1:0": 31500, "amazon.nova-micro-v1:0": 127000, "amazon.nova-lite-v1:0": 295000,
    "amazon.nova-pro-v1:0": 295000, "amazon.nova-premier-v1:0": 995000, "grok": 131072, "grok-beta": 131072,
    "grok-vision-beta": 8192, "grok-2": 131072, "grok-2-latest": 131072, "grok-2-1212": 131072,
    "grok-2-vision": 32768, "grok-2-vision-latest": 32768, "grok-2-vision-1212": 32768, "grok-3": 131072,
    "grok-3-fast": 131072, "grok-3-mini": 131072, "grok-3-mini-fast": 131072, "grok-4": 256000, "kimi": 131000,
    "gpt-oss-20b": 131000, "gpt-oss-120b": 131000,
}
# Output limits of the anthropic endpoint.
ANTHROPIC_OUTPUT_LIMITS = {
    "claude-3-haiku": 4096, "claude-3-sonnet": 4096, "claude-3-opus": 4096, "claude-opus-4": 32000,
    "claude-sonnet-4": 64000, "claude-3.5-sonnet": 8192, "claude-3-5-sonnet": 8192, "claude-3.7-sonnet": 128000,
    "claude-3-7-sonnet": 128000,
}
# Output limits of the other endpoints, and the limit of models without one.
OPENAI_OUTPUT_LIMITS = {
    "o1": 32268, "o1-mini": 65136, "o1-preview": 32268, "gpt-5": 128000, "gpt-5-mini": 128000, "gpt-5-nano": 128000,
    "gpt-oss-20b": 131000, "gpt-oss-120b": 131000,
}
# Models at their own endpoints; no name of one endpoint is part of a name of the other.
OUTPUT_LIMITS = OPENAI_OUTPUT_LIMITS | ANTHROPIC_OUTPUT_LIMITS
OUTPUT_DEFAULT = 1024
