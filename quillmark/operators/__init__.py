"""Relations over a corpus of files, as DataFrame functions."""
