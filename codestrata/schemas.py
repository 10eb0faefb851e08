"""Explicit schemas of all tables; nothing is inferred."""

from __future__ import annotations

CHUNK = "path string, name string, kind string, start_line int, end_line int, code string, hash string, language string"
CHUNK_ROW = "id string, path string, name string, kind string, start_line int, end_line int, hash string, language string"
CONTENT = "hash string, code string"
EMBEDDING = "model_id string, hash string, vector array<float>"
VERSION = (
    "commit string, short string, mode string, base string, refs array<string>, n_files int, n_chunks int, files_rechunked int, files_carried int, "
    "files_deleted int, chunks_carried int, chunks_embedded int, chunks_reused int, embeddings_new int, chunk_s double, embed_s double, save_s double, "
    "build_s double, git_parent string, committed_at string, subject string, model_id string, built_at string"
)
TREE = "commit string, path string, blob string, mode string"
DIFF = "base string, commit string, status string, path string"
COMMITS = "commit string, git_parent string, committed_at string, subject string"
