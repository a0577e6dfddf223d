"""Fixed prompt texts and tags (fixed values: they must read exactly like this
for generated requests and training rows to match)."""

REASONING_START = "<think>"
REASONING_END = "</think>"
SOLUTION_START = "<answer>"
SOLUTION_END = "</answer>"

SYSTEM_PROMPT = (
    "You are given a set of Reddit discussion threads. \n"
    "Identify the thread that is most relevant to the given question.\n"
    "Think about the question and provide your working out.\n"
    "Place it between <think> and </think>.\n"
    "Then, answer the question using only information from that selected thread.\n"
    "Provide your answer between <answer></answer>.\n"
)

DEFAULT_GEN_SYSTEM = "You are a helpful assistant."

QUESTION_PROMPT = """Given an excerpt from a Reddit discussion, write a question that corresponds to the content of this discussion.

Answer in this template/outline:
```xml
<question>
your question
</question>
```
If there is insufficient information in this discussion to form a question, respond with empty blocks in this template:
```xml
<question>
</question>
```
Additional notes:
- Question should NOT mention the discussion or explicitly include Reddit terms such as "comment", "post", "thread", "author", or "OP"."""

ANSWER_PROMPT = """Given an excerpt from a Reddit discussion and a question, write an answer that corresponds to the content of this discussion, referencing only the post and comments.

In your reasoning, carefully review the post and every comment and walk through your thought process before answering (what parts of the discussion are meaningful and why).

Answer in this template:
```
<analysis>
Let's break this down.

The question is asking...

The post discusses... It mentions...

(For each comment)
Comment 1 mentions...

Comment 2 mentions...

...

The key ideas presented in this discussion include...

Therefore, the answer should be about...
</analysis>
<answer>
your answer
</answer>
```

Additional notes:
- Answer should NOT mention the discussion or explicitly include Reddit terms such as "comment", "post", "thread", "author", or "OP"."""

CONTEXT_FRAME_HEAD = ("Here is the context containing the original post and any previous comments before the given "
                      "Reddit comment. This information should only be used for understanding the context of the "
                      "comment.\n```xml\n")
CONTEXT_FRAME_MID = "\n```\nHere is the Reddit comment:\n```xml\n"
PLAIN_FRAME_HEAD = "Here is the Reddit discussion:\n```xml\n"
FRAME_TAIL = "\n```"

# Response parsing (Java syntax; \z is the absolute end of input).
QUESTION_RE = r"(?s)<question>(.*?)(?:</question>|```|\z)"
ANSWER_RE = r"(?s)<analysis>(.*?)</analysis>[ \t\n\r\f\x0B]*(?:<answer>)?(.*?)(?:</answer>|```|\z)"
ANSWER_MATCH_RE = r"(?s)<analysis>.*?</analysis>"
MAX_ATTEMPTS = 5

EOS_TOKEN = "</s>"


def extra_instructions(lines: list[str]) -> str:
    return ("\n" + "\n".join(f"- {x}" for x in lines)) if lines else ""
