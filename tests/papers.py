"""Made-up papers in markdown, for tests."""

ARTICLE = """# A Study of Paper Folding and Its Effect on Reading

Anna Berg, Carl D. Ek and Dora Frost

## Abstract

We fold paper and read it. The effect is small but it is real and we can measure it well.

## Introduction

Paper has been folded for a long time, and people have read it before and after. Nobody has asked what that does.

## Results

We found that folding helps. It helps most on Mondays. The second fold helps less than the first one did.

Table 1

| a | b |
|---|---|
| 1 | 2 |

Figure 2 The folds.

## Methods

We measured folds with a ruler. Samples were taken at random from one large box.

## References

1. Berg A. Folding. 2001.

2. Ek C. Unfolding. 2002.
"""

MAJOR = ARTICLE.replace("## ", "# ").replace("# A Study of Paper Folding and Its Effect on Reading", "# Another Study of Paper Folding and Its Use")

REVIEW = """# What We Know About Lamps and Shades Today

## Summary

Lamps give light, and shades take some of it away again, which this text is about.

## Lamps

Lamps were made first. This review tells of them, and it is now clear that they were bright from the start.

## Shades

Shades came later. In summary, they dim lamps.

## Bibliography

1. Lamp L. Light. 1999.
"""


def pdf(markdown: str) -> bytes:
    return b"%PDF-1.4\n" + markdown.encode()
