"""Operators for preparing training text, each over whole tables.

==========================  ======================================================
``pivots``                  near-duplicate vectors by a pivot-permutation index
``packing``                 best-fit packing of token sequences
``cotraining``              quality classifier from two views
``likelihood_ratio``        quality rules by a word-pair likelihood ratio
``toxicity``                class-conditional Kneser-Ney models
``forest``                  near-duplicate texts by an LSH forest
``byte_bpe``                byte-level BPE over distinct words
``surrogates``              replacing personal data
``language``                language identification
``captures``                WARC archives with a two-level capture index
``licenses``                license texts by votes for diagonals
``repair``                  conversations brought back into turn
``periodic``                stretches that repeat with a period
==========================  ======================================================

Rows with nulls, empty and repeated rows are kept unless an operator says otherwise;
columns it does not name are ignored, whatever their names.
"""
