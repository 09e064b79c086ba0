"""Reading and writing: files, exports, snapshots, change feeds."""
