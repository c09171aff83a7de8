"""Keep the BLAS of the driver on one thread.

Driver-side matrices are sample-sized; in a local session BLAS threads only
compete with the task threads, and were seen to stall there.  The usual
environment variable is read when numpy loads, which is before this package does.
"""
import ctypes

# Names under which OpenBLAS builds export the setter.
SETTERS = ["scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"]


def single_thread() -> bool:
    try:
        with open("/proc/self/maps") as f:
            paths = {line.split()[-1] for line in f if "openblas" in line}
    except OSError:
        return False
    done = False
    for p in paths:
        lib = ctypes.CDLL(p)
        for name in SETTERS:
            if hasattr(lib, name):
                getattr(lib, name)(1)
                done = True
    return done
